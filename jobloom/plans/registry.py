"""Name → query callable ``(spark, sf_dir) -> DataFrame`` for every implemented operator."""

from __future__ import annotations

from jobloom.plans import ingest, maintenance as mt, scalars, serving, streaming, upkeep, vendor

QUERIES = {
    "ranked_top50": lambda spark, sf: serving.ranked_top(spark, sf, 50),
    "ranked_all": serving.ranked_all,
    "ranked_with_targets": serving.ranked_with_targets,
    # scalar functions
    "job_ids": scalars.job_ids,
    "fuzzy_keys": scalars.fuzzy_keys,
    "doc_normalise": scalars.doc_normalise,
    "relative_dates": scalars.relative_dates,
    "salary_parse": scalars.salary_parse,
    "listing_flags": scalars.listing_flags,
    "infer_websites": scalars.infer_websites,
    "url_domains": scalars.url_domains,
    "size_buckets": scalars.size_buckets,
    "location_format": scalars.location_format,
    "member_cities": scalars.member_cities,
    "title_case": scalars.title_case,
    "description_truncate": scalars.description_truncate,
    "html_teaser": scalars.html_teaser,
    "date_labels": scalars.date_labels,
    # de-dup and table maintenance
    "dedup_jobs": mt.dedup_jobs,
    "dedup_exact_id": mt.dedup_exact_id,
    "dedup_counters": mt.dedup_counters,
    "run_counters": mt.run_counters,
    "store_insert": mt.store_insert,
    "job_enrichment_update": mt.job_enrichment_update,
    "company_upsert": mt.company_upsert,
    "member_replace": mt.member_replace,
    "expire_jobs": mt.expire_jobs,
    "csv_jobs": mt.csv_jobs,
    "csv_enriched": mt.csv_enriched,
    # stored tables changed in place, partition by partition
    "merge_partitions": upkeep.merge_partitions,
    "replace_partitions": upkeep.replace_partitions,
    "expire_partitions": upkeep.expire_partitions,
    "company_360_incremental": upkeep.company_360_incremental,
    # serving
    "store_jobs_list": serving.store_jobs_list,
    "ui_jobs": serving.ui_jobs,
    "keyword_search": serving.keyword_search,
    "keyword_search_indexed": serving.keyword_search_indexed,
    "search_result_count": serving.search_result_count,
    "job_by_id": serving.job_by_id,
    "company_by_id": serving.company_by_id,
    "member_by_id": serving.member_by_id,
    "jobs_of_company": serving.jobs_of_company,
    "members_of_company": serving.members_of_company,
    "members_of_company_country": serving.members_of_company_country,
    "job_by_id_clustered": serving.job_by_id_clustered,
    "jobs_of_company_clustered": serving.jobs_of_company_clustered,
    "recent_jobs_of_company": serving.recent_jobs_of_company,
    "members_of_company_clustered": serving.members_of_company_clustered,
    "remote_jobs": serving.remote_jobs,
    "list_view": serving.list_view,
    "enriched_assembly": serving.enriched_assembly,
    "company_360": serving.company_360,
    "company_people": serving.company_people,
    "company_jobs": serving.company_jobs,
    "job_company": serving.job_company,
    "member_company": serving.member_company,
    "company_list": serving.company_list,
    "members_by_country": serving.members_by_country,
    "country_rollup": serving.country_rollup,
    "company_countries": serving.company_countries,
    "jobs_per_company": serving.jobs_per_company,
    "member_preview": serving.member_preview,
    "top_jobs_cli": serving.top_jobs_cli,
    "distinct_companies": serving.distinct_companies,
    "enrichment_work_list": serving.enrichment_work_list,
    "digest_top10": serving.digest_top10,
    "saved_search": serving.saved_search,
    "saved_search_types": serving.saved_search_types,
    "enriched_team": serving.enriched_team,
    # landed pages and payloads
    "embedded_jobs": ingest.embedded_jobs,
    "page_totals": ingest.page_totals,
    "dom_jobs": ingest.dom_jobs,
    "selector_jobs": ingest.selector_jobs,
    "extracted_jobs": ingest.extracted_jobs,
    "hybrid_jobs": ingest.hybrid_jobs,
    "embedded_dirty": ingest.embedded_dirty,
    "embedded_rejects": ingest.embedded_rejects,
    "extracted_dirty": ingest.extracted_dirty,
    "search_results": ingest.search_results,
    "blocked_pages": ingest.blocked_pages,
    "source_fallback": ingest.source_fallback,
    "page_links": ingest.page_links,
    "page_titles": ingest.page_titles,
    # vendor landing
    "vendor_a_company": vendor.vendor_a_company,
    "vendor_b_company": vendor.vendor_b_company,
    "vendor_a_people": vendor.vendor_a_people,
    "vendor_b_people": vendor.vendor_b_people,
    "vendor_head_count": vendor.vendor_head_count,
    "company_metadata": vendor.company_metadata,
    "employer_match": vendor.employer_match,
    "people_cap": vendor.people_cap,
    "vendor_people": vendor.vendor_people,
    "people_by_employer": vendor.people_by_employer,
    "company_websites_labelled": vendor.company_websites_labelled,
    "company_websites_plain": vendor.company_websites_plain,
    "company_websites": vendor.company_websites,
    "company_page_links": vendor.company_page_links,
    # streaming ingest: the stored ids don't depend on how files fall into micro-batches
    "stream_ingest": streaming.stream_ingest,
}
