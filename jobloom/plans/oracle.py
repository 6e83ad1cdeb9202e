"""DuckDB oracle SQL for the registered queries.

The driver runs these against the same parquet files (views named after the
driver tables).  ``PRELUDE`` derives the job-postings tables exactly like
``jobloom.sources.fixtures`` does, so every oracle is plain SQL over the
given tables.
"""

from __future__ import annotations

AS_OF_SQL = "TIMESTAMP '2001-09-01 12:00:00'"

PRELUDE = f"""
WITH
np AS (SELECT count(*) AS n FROM part),
ns AS (SELECT count(*) AS n FROM supplier),
jobs_raw AS (
  SELECT o.o_orderkey AS seq,
    CASE o.o_orderkey % 5 WHEN 0 THEN 'Senior ' || p.p_name WHEN 1 THEN 'Sr. ' || p.p_name
         WHEN 2 THEN p.p_name || ' - Remote' WHEN 3 THEN upper(p.p_name) ELSE p.p_name END AS title,
    s.s_name AS company,
    CASE WHEN o.o_orderkey % 4 = 0 THEN 'Remote' ELSE 'City ' || CAST(o.o_custkey % 9 AS VARCHAR) END AS location,
    '<p>' || p.p_type || ' ' || p.p_brand || '</p> ' || o.o_orderpriority AS description,
    CASE WHEN o.o_orderkey % 13 = 0 THEN '' ELSE 'https://jobs.example.com/viewjob?jk=' || CAST(o.o_orderkey // 3 AS VARCHAR) END AS url,
    (['Just posted', 'Today', '3 days ago', '30+ days ago', '2 weeks ago', '5 hours ago', '',
      'PostedPosted 4 days ago'])[CAST(o.o_orderkey % 8 AS INTEGER) + 1] AS posted_text,
    (['$50,000 - $70,000 a year', '$25 - $35 an hour', '$80K - $100K', '$800 a week', '',
      NULL])[CAST(o.o_orderkey % 6 AS INTEGER) + 1] AS salary_text,
    CAST(DATE '2001-09-01' - CAST(o.o_orderkey % 60 AS INTEGER) AS TIMESTAMP) + INTERVAL 6 HOUR AS posted_date,
    CAST(DATE '2001-09-01' - CAST(o.o_orderkey % 60 AS INTEGER) AS TIMESTAMP) + INTERVAL 7 HOUR AS scraped_at,
    'indeed' AS board_source
  FROM orders o
  JOIN part p ON p.p_partkey = o.o_orderkey % (SELECT n FROM np)
  JOIN supplier s ON s.s_suppkey = o.o_custkey % (SELECT n FROM ns)
),
jobs AS (
  SELECT *, substr(md5(lower(coalesce(company, 'None') || ':' || coalesce(title, 'None') || ':'
                             || coalesce(location, 'None'))), 1, 16) AS id
  FROM jobs_raw
),
members AS (
  SELECT c_custkey AS id,
    CAST((c_custkey % 7) * (c_custkey % 11) % (SELECT n FROM ns) AS VARCHAR) AS company_id,
    c_name AS name, c_mktsegment AS title,
    (['Taiwan', 'China', 'Singapore', 'Hong Kong', 'Japan', NULL])[CAST(c_nationkey % 6 AS INTEGER) + 1] AS country,
    c_custkey AS ck
  FROM customer
),
team_members AS (
  SELECT id, company_id, name, title,
    nullif(concat_ws(', ', city, country), '') AS location, city, country,
    'https://www.linkedin.com/in/member-' || CAST(id AS VARCHAR) AS linkedin_url
  FROM (
    SELECT *, CASE country
      WHEN 'Taiwan' THEN (['Taipei', 'Hsinchu', 'Tainan'])[CAST(ck % 3 AS INTEGER) + 1]
      WHEN 'China' THEN (['Shanghai', 'Chengdu', 'Beijing'])[CAST(ck % 3 AS INTEGER) + 1]
      WHEN 'Singapore' THEN 'Singapore' WHEN 'Hong Kong' THEN 'Hong Kong' END AS city
    FROM members)
),
region_counts AS (
  SELECT company_id, CAST(count(*) AS INTEGER) AS region_team_count FROM team_members
  WHERE country IN ('Taiwan', 'China', 'Singapore', 'Hong Kong') GROUP BY company_id
),
companies AS (
  SELECT CAST(s.s_suppkey AS VARCHAR) AS id, s.s_name AS name, s.s_name AS requested_name,
    CAST(NULL AS VARCHAR) AS linkedin_url,
    'supplier' || CAST(s.s_suppkey AS VARCHAR) || '.com' AS website,
    (['Information Technology', 'SaaS Platforms', 'Fintech', 'Manufacturing', NULL])[CAST(s.s_suppkey % 5 AS INTEGER) + 1] AS industry,
    (['1-10', '11-50', '51-200', '201-500', '5000+', NULL])[CAST(s.s_suppkey % 6 AS INTEGER) + 1] AS company_size,
    n.n_name AS headquarters_location,
    CAST(NULL AS VARCHAR) AS description, CAST(NULL AS INTEGER) AS total_employees,
    CASE WHEN s.s_suppkey % 10 = 9 THEN TIMESTAMP '2001-06-01' ELSE TIMESTAMP '2001-08-20' END AS enriched_at,
    'fixture' AS source,
    CAST(coalesce(rc.region_team_count, 0) AS INTEGER) AS region_team_count
  FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey
  LEFT JOIN region_counts rc ON rc.company_id = CAST(s.s_suppkey AS VARCHAR)
),
member_stats AS (
  SELECT company_id, count(*) AS member_count,
    count(*) FILTER (WHERE city IN ('Taipei', 'Hsinchu', 'Taichung', 'Beijing', 'Shanghai',
                                    'Shenzhen', 'Hangzhou', 'Singapore', 'Hong Kong')) AS preferred_city_count
  FROM team_members GROUP BY company_id
),
fresh AS (
  SELECT c.*, coalesce(ms.member_count, 0) AS member_count,
         coalesce(ms.preferred_city_count, 0) AS preferred_city_count
  FROM companies c LEFT JOIN member_stats ms ON ms.company_id = c.id
  WHERE c.enriched_at >= {AS_OF_SQL} - INTERVAL 30 DAY
),
enriched AS (
  SELECT j.*, f.id AS company_id, f.company_size, f.industry, f.headquarters_location,
    coalesce(f.region_team_count, 0) AS region_team_count,
    coalesce(f.preferred_city_count, 0) AS preferred_city_count,
    coalesce(f.member_count, 0) AS member_count, f.enriched_at
  FROM jobs j LEFT JOIN fresh f ON j.company = f.requested_name
),
ranked AS (
  SELECT *, round(
    least(region_team_count * 10.0, 50.0)
    + CASE WHEN member_count > 0 THEN least(preferred_city_count * 5.0, 20.0) ELSE 0.0 END
    + CASE WHEN posted_date IS NULL THEN 0.0 ELSE greatest(0.0, 5.0 - floor(
        (epoch_us({AS_OF_SQL}) - epoch_us(posted_date)) / 86400000000.0) / 7.0) END, 2) AS ranking_score
  FROM enriched WHERE coalesce(region_team_count, 0) >= 1
)
"""

RANKED_COLS = ("id, seq, title, company, location, posted_date, company_id, region_team_count, "
               "preferred_city_count, industry, company_size, ranking_score")

ORDER_O1 = "ranking_score DESC NULLS LAST, posted_date DESC NULLS LAST, id ASC, seq ASC"


def q(body: str) -> str:
    return PRELUDE + body


ORACLE: dict[str, str] = {}


def register(name: str, body: str) -> None:
    ORACLE[name] = q(body)


register("ranked_top50", f"SELECT {RANKED_COLS} FROM ranked ORDER BY {ORDER_O1} LIMIT 50")
register("ranked_all", f"SELECT {RANKED_COLS} FROM ranked")


# ---------------------------------------------------------------- SQL helpers
from jobloom.constants import (LEGAL_SUFFIX_ALTERNATIVES, PY_SPACE_CLASS,  # noqa: E402
                               PY_WORD_CLASS, SALARY_PATTERN)

WS = PY_SPACE_CLASS


def s_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def s_normalise(x: str) -> str:
    s = f"regexp_replace(lower({x}), '[^{PY_WORD_CLASS}{WS}]', ' ', 'g')"
    s = f"regexp_replace({s}, '[{WS}]+', ' ', 'g')"
    return f"trim({s})"


def s_fuzzy(company: str, title: str) -> str:
    t = s_normalise(title)
    for old, new in (("senior", "sr"), ("junior", "jr"), ("remote", ""), ("hybrid", "")):
        t = f"replace({t}, '{old}', '{new}')"
    t = f"trim(replace({t}, '  ', ' '))"
    return f"{s_normalise(company)} || ':' || {t}"


def s_shift(now: str, t: str) -> str:
    n = f"TRY_CAST(regexp_extract({t}, '(\\d+)', 1) AS INTEGER)"
    return (f"CASE WHEN {n} IS NULL THEN {now} "
            f"WHEN contains({t}, 'hour') THEN {now} - to_hours({n}) "
            f"WHEN contains({t}, 'day') THEN {now} - to_days({n}) "
            f"WHEN contains({t}, 'week') THEN {now} - to_days(7 * {n}) "
            f"WHEN contains({t}, 'month') THEN {now} - to_days(30 * {n}) ELSE {now} END")


def s_rule_a(x: str, now: str = AS_OF_SQL) -> str:
    t = s_strip(f"lower(coalesce({x}, ''))")
    return f"CASE WHEN {t} IN ('', 'just posted', 'today') THEN {now} ELSE {s_shift(now, t)} END"


def s_rule_b(x: str, now: str = AS_OF_SQL) -> str:
    t = s_strip(f"replace({s_strip(f'lower(coalesce({x}, {chr(39)}{chr(39)}))')}, 'posted', '')")
    return (f"CASE WHEN {t} = '' OR {t} = 'just' OR contains({t}, 'today') THEN {now} "
            f"ELSE {s_shift(now, t)} END")


def s_salary_vals(x: str) -> str:
    t = f"coalesce({x}, '')"
    low = f"lower({t})"
    v = (f"list_filter(list_transform(regexp_extract_all({t}, '{SALARY_PATTERN}', 1), "
         f"lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE)), lambda v: v IS NOT NULL)")
    v = f"list_transform({v}, lambda v: CASE WHEN contains({low}, 'k') AND v < 1000 THEN v * 1000 ELSE v END)"
    v = f"list_transform({v}, lambda v: CASE WHEN contains({low}, 'hour') AND v < 500 THEN v * 2080 ELSE v END)"
    return v


def s_days(ts: str, now: str = AS_OF_SQL) -> str:
    return f"CAST(floor((epoch_us({now}) - epoch_us({ts})) / 86400000000.0) AS BIGINT)"


def s_md5_16(x: str) -> str:
    return f"substr(md5({x}), 1, 16)"


def s_infer_website(x: str) -> str:
    s = f"regexp_replace(lower({x}), '[{WS}]+{LEGAL_SUFFIX_ALTERNATIVES}$', '')"
    s = f"regexp_replace({s}, '[^{PY_WORD_CLASS}{WS}-]', '', 'g')"
    s = f"regexp_replace({s}, '[-{WS}]+', '', 'g')"
    return f"{s} || '.com'"


def s_url_domain(u: str) -> str:
    rest = f"regexp_replace({u}, '^[A-Za-z][A-Za-z0-9+.-]*:', '')"
    netloc = f"CASE WHEN starts_with({rest}, '//') THEN regexp_extract({rest}, '^//([^/?#]*)', 1) ELSE '' END"
    path = (f"CASE WHEN starts_with({rest}, '//') THEN regexp_extract({rest}, '^//[^/?#]*([^?#]*)', 1) "
            f"ELSE regexp_extract({rest}, '^([^?#]*)', 1) END")
    dom = f"(CASE WHEN {netloc} <> '' THEN {netloc} ELSE {path} END)"
    dom = f"(CASE WHEN starts_with({dom}, 'www.') THEN substr({dom}, 5) ELSE {dom} END)"
    return (f"CASE WHEN {u} IS NULL OR NOT contains({dom}, '.') THEN NULL "
            f"ELSE nullif(split_part({dom}, '/', 1), '') END")


def s_size_bucket(n: str) -> str:
    return (f"CASE WHEN {n} IS NULL THEN NULL WHEN {n} <= 10 THEN '1-10' WHEN {n} <= 50 THEN '11-50' "
            f"WHEN {n} <= 200 THEN '51-200' WHEN {n} <= 500 THEN '201-500' "
            f"WHEN {n} <= 1000 THEN '501-1000' WHEN {n} <= 5000 THEN '1001-5000' ELSE '5000+' END")


def s_city(loc: str, ctry: str) -> str:
    gaz = [("Taiwan", ["Taipei", "Hsinchu", "Taichung", "Tainan", "Kaohsiung"]),
           ("China", ["Beijing", "Shanghai", "Shenzhen", "Guangzhou", "Hangzhou", "Chengdu"]),
           ("Singapore", ["Singapore"]), ("Hong Kong", ["Hong Kong"])]
    low = f"lower({loc})"

    def hit(cities):
        return "CASE " + " ".join(f"WHEN contains({low}, '{c.lower()}') THEN '{c}'" for c in cities) + " END"
    alls = [c for _, cs in gaz for c in cs]
    body = " ".join(f"WHEN {ctry} = '{k}' THEN {hit(cs)}" for k, cs in gaz)
    return (f"CASE WHEN coalesce({low}, '') = '' THEN NULL ELSE (CASE {body} ELSE {hit(alls)} END) END")


def s_initcap(x: str) -> str:
    return (f"array_to_string(list_transform(string_split(lower({x}), ' '), "
            f"lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')")


def s_age_label(ts: str, now: str = AS_OF_SQL) -> str:
    d = f"CAST(ceil(abs(epoch_us({now}) - epoch_us({ts})) / 86400000000.0) AS BIGINT)"
    return (f"CASE WHEN {d} = 0 THEN 'Today' WHEN {d} = 1 THEN 'Yesterday' "
            f"WHEN {d} < 7 THEN CAST({d} AS VARCHAR) || ' days ago' "
            f"WHEN {d} < 30 THEN CAST({d} // 7 AS VARCHAR) || ' weeks ago' "
            f"ELSE CAST({d} // 30 AS VARCHAR) || ' months ago' END")


def s_iso(ts: str) -> str:
    return (f"coalesce(CASE WHEN microsecond({ts}) % 1000000 = 0 THEN strftime({ts}, '%Y-%m-%dT%H:%M:%S') "
            f"ELSE strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f') END, '')")


def s_truncate(x: str, n: int = 200) -> str:
    return f"CASE WHEN length({x}) > {n} THEN substr({x}, 1, {n}) || '...' ELSE {x} END"


# ----------------------------------------------------------- scalar queries
register("job_ids", f"SELECT seq, id, {s_md5_16('lower(company)')} AS company_key FROM jobs")
register("fuzzy_keys", f"SELECT seq, {s_fuzzy('company', 'title')} AS fuzzy_key FROM jobs")
register("doc_normalise", f"""SELECT doc_id, md5(n) AS norm_md5, CAST(length(n) AS INTEGER) AS norm_len
FROM (SELECT doc_id, {s_normalise('text')} AS n FROM documents)""")
register("relative_dates", f"""SELECT seq, posted_text, {s_rule_a('posted_text')} AS posted_rule_a,
  {s_rule_b('posted_text')} AS posted_rule_b FROM jobs""")
register("salary_parse", f"""SELECT seq,
  CASE WHEN len(v) > 0 THEN list_min(v) END AS salary_min,
  CASE WHEN len(v) > 0 THEN list_max(v) END AS salary_max
FROM (SELECT seq, {s_salary_vals('salary_text')} AS v FROM jobs)""")
register("listing_flags", """SELECT seq,
  CASE WHEN seq % 7 = 0 OR contains(lower(location), 'remote') THEN 'Remote' END AS remote_type,
  CASE WHEN k <> '' THEN 'https://www.indeed.com/viewjob?jk=' || k ELSE '' END AS job_url,
  CASE WHEN k <> '' AND coalesce(iu, '') = '' THEN 'https://www.indeed.com/viewjob?jk=' || k
       WHEN coalesce(iu, '') <> '' AND NOT starts_with(iu, 'http') THEN 'https://www.indeed.com' || iu
       ELSE coalesce(iu, '') END AS item_url,
  CASE WHEN coalesce(direct, '') <> '' THEN direct
       WHEN cmp IS NOT NULL AND cmp <> '' AND NOT starts_with(cmp, 'http') THEN 'https://www.indeed.com' || cmp
       ELSE cmp END AS company_url,
  coalesce(nullif(CASE WHEN seq % 2 = 0 THEN '' ELSE description END, ''),
           array_to_string(string_split(title, ' '), ' ')) AS description
FROM (SELECT *, CASE WHEN seq % 13 = 0 THEN '' ELSE CAST(seq AS VARCHAR) END AS k,
        CASE WHEN seq % 3 = 0 THEN '/viewjob?jk=' || CAST(seq AS VARCHAR) WHEN seq % 3 = 1 THEN url END AS iu,
        CASE WHEN seq % 2 = 0 THEN '/cmp/' || replace(company, '#', '-') END AS cmp,
        CASE WHEN seq % 5 = 0 THEN 'https://direct.example.com/c' END AS direct
      FROM jobs)""")
register("infer_websites", f"""SELECT s_suppkey, name, {s_infer_website('name')} AS website
FROM (SELECT s_suppkey, s_name || ([' Inc.', ' LLC', ' Corporation', ' co', '', ' Ltd', ' - Labs Co.'])[CAST(s_suppkey % 7 AS INTEGER) + 1] AS name
      FROM supplier)""")
register("url_domains", f"""SELECT page_id, {s_url_domain('url')} AS domain,
  {s_url_domain("regexp_replace(url, '^https?://', '')")} AS bare_domain FROM pages""")
register("size_buckets", f"""SELECT c_custkey, n AS employee_count, {s_size_bucket('n')} AS company_size
FROM (SELECT c_custkey, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(c_custkey * 7 % 7000 AS INTEGER) END AS n FROM customer)""")
register("location_format", """SELECT id, nullif(concat_ws(', ', nullif(city, ''),
  nullif(CASE WHEN id % 3 = 0 THEN '' ELSE title END, ''), nullif(country, '')), '') AS location FROM team_members""")
register("member_cities", f"""SELECT id, loc AS location_text, hint AS country_hint, {s_city('loc', 'hint')} AS city
FROM (SELECT id, CASE WHEN id % 5 = 0 THEN 'New Taipei City, ' || coalesce(country, '')
                      WHEN id % 5 = 1 THEN upper(coalesce(location, '')) ELSE location END AS loc,
             CASE WHEN id % 2 = 0 THEN country END AS hint FROM team_members)""")
register("title_case", f"SELECT id, coalesce({s_initcap('country')}, '') AS country FROM team_members")
register("description_truncate", f"""SELECT doc_id, md5(t) AS cut_md5, CAST(length(t) AS INTEGER) AS cut_len
FROM (SELECT doc_id, {s_truncate('text')} AS t FROM documents)""")
register("html_teaser", """SELECT page_id, substr(regexp_replace(html, '<[^>]*>', '', 'g'), 1, 200) || '...' AS teaser FROM pages""")
register("date_labels", f"""SELECT seq, {s_age_label('posted_date')} AS age_label, {s_iso('posted_date')} AS posted_iso,
  strftime(posted_date, '%B %-d, %Y') AS posted_long, {s_days('posted_date')} AS age_days FROM jobs""")


# ------------------------------------------------------------ de-dup oracle
def s_score(cnt: str, pcc: str, mc: str, posted: str) -> str:
    return (f"round(least({cnt} * 10.0, 50.0) + CASE WHEN {mc} > 0 THEN least({pcc} * 5.0, 20.0) ELSE 0.0 END"
            f" + CASE WHEN {posted} IS NULL THEN 0.0 ELSE greatest(0.0, 5.0 - floor((epoch_us({AS_OF_SQL})"
            f" - epoch_us({posted})) / 86400000000.0) / 7.0) END, 2)")


def dedup_ctes(source: str = "jobs", rounds: int = 14) -> str:
    """The round step of the distributed greedy de-dup, unrolled ``rounds`` times.

    Ends with ``dd_kept(o)`` and an error if any row is still undecided.
    """
    parts = [f"""dd_kr AS MATERIALIZED (SELECT seq AS o, 0 AS kt, id AS kv FROM {source} WHERE id IS NOT NULL
  UNION ALL SELECT seq, 1, {s_fuzzy('company', 'title')} FROM {source}
  UNION ALL SELECT seq, 2, url FROM {source} WHERE coalesce(url, '') <> ''),
dd_pri AS (SELECT seq AS o, row_number() OVER (ORDER BY scraped_at DESC NULLS LAST, seq) AS r FROM {source}),
dd_nk AS MATERIALIZED (SELECT o, count(*) AS n FROM dd_kr GROUP BY o),
dd_e0 AS MATERIALIZED (SELECT dd_kr.o, dd_pri.r * 4 + dd_nk.n AS p, kt, kv
  FROM dd_kr JOIN dd_pri USING (o) JOIN dd_nk USING (o))"""]
    for i in range(1, rounds + 1):
        prev = f"dd_e{i - 1}"
        parts.append(f"""dd_w{i} AS MATERIALIZED (SELECT kt, kv, min(p) AS w FROM {prev} GROUP BY kt, kv),
dd_k{i} AS MATERIALIZED (SELECT w AS kw FROM dd_w{i} GROUP BY w HAVING count(*) = w % 4),
dd_m{i} AS MATERIALIZED (SELECT e.o, e.p, e.kt, e.kv,
    max(CASE WHEN k.kw IS NOT NULL AND g.w = e.p THEN 1 ELSE 0 END) OVER (PARTITION BY e.p) AS won,
    max(CASE WHEN k.kw IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY e.p) AS hit
  FROM {prev} e JOIN dd_w{i} g USING (kt, kv) LEFT JOIN dd_k{i} k ON k.kw = g.w),
dd_e{i} AS MATERIALIZED (SELECT o, p, kt, kv FROM dd_m{i} WHERE hit = 0)""")
    union = " UNION ALL ".join(f"SELECT o FROM dd_m{i} WHERE won = 1" for i in range(1, rounds + 1))
    parts.append(f"""dd_keyless AS MATERIALIZED (SELECT p.o FROM dd_pri p ANTI JOIN dd_nk n ON p.o = n.o),
dd_kept AS MATERIALIZED (SELECT DISTINCT o FROM ({union} UNION ALL SELECT o FROM dd_keyless)),
dd_left AS MATERIALIZED (SELECT count(*) AS c FROM dd_e{rounds}),
dd_ok AS (SELECT CASE WHEN c > 0 THEN error('de-dup oracle: rows still undecided') ELSE TRUE END AS ok
  FROM dd_left)""")
    return ",\n".join(parts)


DEDUP_COLS = "seq, id, title, company, url, scraped_at"
register("dedup_jobs", f""", {dedup_ctes()}
SELECT {DEDUP_COLS} FROM jobs SEMI JOIN dd_kept ON jobs.seq = dd_kept.o
WHERE (SELECT ok FROM dd_ok)""")
register("dedup_exact_id", """SELECT id, seq FROM jobs
QUALIFY row_number() OVER (PARTITION BY id ORDER BY scraped_at DESC, seq) = 1""")
register("dedup_counters", f""", {dedup_ctes()}
SELECT count(*) AS input_rows, count(k.o) AS kept_rows, count(*) - count(k.o) AS duplicates
FROM jobs LEFT JOIN dd_kept k ON jobs.seq = k.o WHERE (SELECT ok FROM dd_ok)""")

# ------------------------------------------------------- table maintenance
STORE_CTES = f"""
landed AS (SELECT seq, id, title, company, location, description, url, posted_date, scraped_at, board_source FROM jobs),
early AS (SELECT * FROM landed WHERE scraped_at < TIMESTAMP '2001-08-15 00:00:00'),
late AS (SELECT * FROM landed WHERE scraped_at >= TIMESTAMP '2001-08-15 00:00:00'),
s1 AS (SELECT * FROM early QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1),
s2 AS (SELECT * FROM late WHERE id NOT IN (SELECT id FROM s1)
       QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1),
stored AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2),
st_enr AS (SELECT s.*, f.id AS f_company_id, f.company_size AS f_size, f.industry AS f_industry,
    f.headquarters_location AS f_hq, coalesce(f.region_team_count, 0) AS f_cnt,
    coalesce(f.preferred_city_count, 0) AS f_pcc, coalesce(f.member_count, 0) AS f_mc
  FROM stored s LEFT JOIN fresh f ON s.company = f.requested_name),
st_ranked AS (SELECT *, {s_score('f_cnt', 'f_pcc', 'f_mc', 'posted_date')} AS f_score
  FROM st_enr WHERE f_cnt >= 1),
st_upd AS (SELECT s.id, s.seq, s.title, s.company, s.location, s.description, s.url, s.posted_date, s.scraped_at,
    s.board_source,
    CASE WHEN r.id IS NOT NULL THEN r.f_company_id END AS company_id,
    CASE WHEN r.id IS NOT NULL THEN r.f_cnt ELSE 0 END AS region_team_count,
    CASE WHEN r.id IS NOT NULL THEN r.f_score ELSE 0.0 END AS ranking_score,
    CASE WHEN r.id IS NOT NULL THEN {AS_OF_SQL} END AS enriched_at,
    CASE WHEN r.id IS NOT NULL THEN r.f_size END AS company_size,
    CASE WHEN r.id IS NOT NULL THEN r.f_industry END AS industry,
    CASE WHEN r.id IS NOT NULL THEN r.f_hq END AS headquarters_location
  FROM stored s LEFT JOIN st_ranked r ON r.id = s.id),
c_upd AS (
  SELECT id, name, requested_name, linkedin_url, website, coalesce(industry, 'None') || ' (updated)' AS industry,
    company_size, headquarters_location, description, total_employees, {AS_OF_SQL} AS enriched_at, source, region_team_count
  FROM companies WHERE CAST(id AS BIGINT) % 3 = 0
  UNION ALL
  SELECT CAST(CAST(id AS BIGINT) + 1000000 AS VARCHAR), name || ' Holdings', name || ' Holdings', linkedin_url, website,
    industry, company_size, headquarters_location, description, total_employees, {AS_OF_SQL}, source, region_team_count
  FROM companies WHERE CAST(id AS BIGINT) % 4 = 1),
c_merged AS (SELECT id, name, industry, enriched_at, region_team_count FROM companies WHERE id NOT IN (SELECT id FROM c_upd)
  UNION ALL SELECT id, name, industry, enriched_at, region_team_count FROM c_upd),
m_fresh AS (SELECT id, CAST(id % 50 AS VARCHAR) AS company_id, name, city,
    CASE WHEN id % 10 = 0 THEN NULL ELSE country END AS country
  FROM team_members WHERE CAST(id % 50 AS VARCHAR) IN (SELECT id FROM c_upd) AND (id % 50) % 6 <> 0),
m_out AS (SELECT id, company_id, name, city, country FROM team_members
    WHERE company_id NOT IN (SELECT company_id FROM m_fresh)
  UNION ALL SELECT id, company_id, name, city, country FROM m_fresh)
"""


def register_store(name: str, body: str) -> None:
    register(name, f", {STORE_CTES}\n{body}")


register_store("store_insert", "SELECT id, seq, scraped_at FROM stored")
register_store("job_enrichment_update", """SELECT id, company_id, region_team_count, ranking_score, enriched_at,
  company_size, industry, headquarters_location FROM st_upd""")
register_store("company_upsert", "SELECT * FROM c_merged")
register_store("member_replace", "SELECT * FROM m_out")
register_store("expire_jobs", f"""SELECT id, seq, scraped_at FROM stored
WHERE scraped_at IS NULL OR scraped_at >= {AS_OF_SQL} - INTERVAL 30 DAY""")
register_store("csv_jobs", f"""SELECT title, company, location, url, {s_iso('posted_date')} AS posted_date,
  {s_truncate('description')} AS description, board_source AS board, {s_iso('scraped_at')} AS scraped_at FROM stored""")
register_store("csv_enriched", f"""SELECT title, company, location, url, f_cnt AS taiwan_team_count, f_score AS ranking_score,
  coalesce(f_industry, '') AS industry, coalesce(f_size, '') AS company_size, {s_iso('posted_date')} AS posted_date,
  {s_truncate('description')} AS description, board_source AS board FROM st_ranked""")


# ----------------------------------------------------------------- serving
LIST = "id, title, company, location, posted_date, company_id, region_team_count, ranking_score, enriched_at"
COMPANY = "id, name, website, industry, company_size, headquarters_location, region_team_count, enriched_at"
O1 = "ranking_score DESC NULLS LAST, posted_date DESC NULLS LAST, id ASC"
ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SEARCH_WHERE = " OR ".join(ASCII_LOWER.format(f) + " LIKE '%ring%'" for f in ("title", "company", "description"))

register_store("store_jobs_list", f"""SELECT {LIST} FROM st_upd
WHERE enriched_at IS NOT NULL AND region_team_count >= 1 ORDER BY {O1} LIMIT 100""")
register_store("ui_jobs", f"SELECT {LIST} FROM st_upd WHERE region_team_count >= 0 ORDER BY {O1} LIMIT 100")
register_store("keyword_search", f"SELECT {LIST} FROM st_upd WHERE {SEARCH_WHERE} ORDER BY {O1} LIMIT 100")
INDEXED_TERMS = ("ring", "economy", "sma%brand#1", "5_low", "d wid", "zzzz", "m ")
register_store("keyword_search_indexed", " UNION ALL ".join(
    f"(SELECT '{shown}' AS term, {LIST} FROM st_upd WHERE " + " OR ".join(
        ASCII_LOWER.format(f) + f" LIKE '%{q}%'" for f in ("title", "company", "description"))
    + f" ORDER BY {O1} LIMIT 100)" for q, shown in
    ((q, "ECONOMY" if q == "economy" else q) for q in INDEXED_TERMS)))
register_store("search_result_count", f"""SELECT count(*) AS n_results FROM
  (SELECT id FROM st_upd WHERE {SEARCH_WHERE} ORDER BY {O1} LIMIT 100)""")
register_store("job_by_id", f"SELECT {LIST} FROM st_upd WHERE id = (SELECT arg_min(id, seq) FROM st_upd)")
register("company_by_id", f"SELECT {COMPANY} FROM companies WHERE id = '1'")
register("member_by_id", "SELECT * FROM team_members WHERE id = 7")
O3 = "country NULLS FIRST, city NULLS FIRST, name NULLS FIRST, id"
register_store("jobs_of_company", f"""SELECT {LIST}, row_number() OVER (ORDER BY {O1}) AS pos
FROM st_upd WHERE company_id = '1'""")
register("members_of_company", f"""SELECT id, company_id, name, city, country,
  row_number() OVER (ORDER BY {O3}) AS pos FROM team_members WHERE company_id = '0'""")
register("members_of_company_country", f"""SELECT id, company_id, name, city, country,
  row_number() OVER (ORDER BY {O3}) AS pos FROM team_members WHERE company_id = '0' AND country = 'Taiwan'""")
register_store("job_by_id_clustered", f"SELECT {LIST} FROM st_upd WHERE id = (SELECT arg_min(id, seq) FROM st_upd)")
register_store("jobs_of_company_clustered", f"""SELECT {LIST}, row_number() OVER (ORDER BY {O1}) AS pos
FROM st_upd WHERE company_id = '1'""")
register_store("recent_jobs_of_company", f"""SELECT {LIST}, row_number() OVER (ORDER BY {O1}) AS pos
FROM st_upd WHERE company_id = '1' AND posted_date >= TIMESTAMP '2001-08-01 00:00:00'""")
register("members_of_company_clustered", f"""SELECT id, company_id, name, city, country,
  row_number() OVER (ORDER BY {O3}) AS pos FROM team_members WHERE company_id = '0' AND country = 'Taiwan'""")
register("remote_jobs", "SELECT seq, id, title, location FROM jobs WHERE contains(lower(location), 'remote')")
register_store("list_view", "SELECT id, title, company, location, url, posted_date, board_source, ranking_score FROM st_upd")
register("enriched_assembly", """SELECT seq, id, company_id, company_size, industry, headquarters_location,
  region_team_count, enriched_at FROM enriched""")
register_store("company_360", """SELECT c.id AS company_id, c.name, c.industry, c.company_size, c.region_team_count,
  coalesce(jc.n, 0) AS open_positions, coalesce(mc.n, 0) AS n_members, coalesce(mc.countries, '') AS countries
FROM companies c
LEFT JOIN (SELECT company_id, count(*) AS n FROM st_upd WHERE company_id IS NOT NULL GROUP BY company_id) jc
  ON jc.company_id = c.id
LEFT JOIN (SELECT company_id, count(*) AS n, array_to_string(list_sort(list_distinct(list(country))), ',') AS countries
  FROM team_members GROUP BY company_id) mc ON mc.company_id = c.id""")
register("company_people", """SELECT t.id, t.company_id, name, title, city, t.country, n_members
FROM (SELECT id, company_id, name, title, city, coalesce(nullif(country, ''), 'Unknown') AS country FROM team_members) t
JOIN (SELECT company_id, coalesce(nullif(country, ''), 'Unknown') AS country, count(*) AS n_members
  FROM team_members GROUP BY 1, 2) c ON c.company_id = t.company_id AND c.country = t.country""")
register_store("company_jobs", """SELECT company_id, id, title, location, posted_date, ranking_score FROM st_upd
WHERE company_id IS NOT NULL""")
register("ranked_with_targets", f""", mt AS (SELECT company_id, count(*) AS mc,
    count(*) FILTER (WHERE city IN ('Taipei', 'Shanghai')) AS pcc FROM team_members GROUP BY company_id)
SELECT id, seq, industry, company_size, region_team_count, round(
  least(region_team_count * 10.0, 50.0) + CASE WHEN coalesce(mc, 0) > 0 THEN least(coalesce(pcc, 0) * 5.0, 20.0) ELSE 0.0 END
  + CASE WHEN coalesce(industry, '') <> '' AND (contains(lower(industry), 'saas') OR contains(lower(industry), 'fintech'))
    THEN 15.0 ELSE 0.0 END
  + CASE WHEN company_size IN ('11-50', '5000+') THEN 9.0 ELSE 0.0 END
  + greatest(0.0, 5.0 - floor((epoch_us({AS_OF_SQL}) - epoch_us(posted_date)) / 86400000000.0) / 7.0), 2) AS ranking_score
FROM enriched LEFT JOIN mt USING (company_id) WHERE region_team_count >= 2""")
register_store("job_company", """SELECT s.id, s.company_id, c.name AS company_name, c.website
FROM st_upd s LEFT JOIN companies c ON c.id = s.company_id""")
register("member_company", """SELECT m.company_id, m.id, m.name, c.name AS company_name
FROM team_members m LEFT JOIN companies c ON c.id = m.company_id""")
register("company_list", f"SELECT {COMPANY} FROM companies ORDER BY region_team_count DESC NULLS LAST, id LIMIT 100")
register("members_by_country", """SELECT company_id, coalesce(nullif(country, ''), 'Unknown') AS country,
  count(*) AS n_members FROM team_members GROUP BY ALL""")
register("country_rollup", """SELECT company_id, coalesce(country, 'Unknown') AS country, count(*) AS n_members
FROM team_members GROUP BY company_id, country
UNION ALL SELECT company_id, 'All', count(*) FROM team_members GROUP BY company_id""")
register("company_countries", """SELECT company_id, country,
  row_number() OVER (PARTITION BY company_id ORDER BY country) AS pos
FROM (SELECT DISTINCT company_id, country FROM team_members WHERE country IS NOT NULL)""")
register_store("run_counters", f"""SELECT
  (SELECT count(*) FROM s2) AS saved, (SELECT count(*) FROM late) - (SELECT count(*) FROM s2) AS skipped,
  (SELECT count(*) FROM stored WHERE scraped_at < {AS_OF_SQL} - INTERVAL 30 DAY) AS deleted,
  (SELECT count(*) FROM enriched WHERE region_team_count >= 1) AS ranked,
  (SELECT count(*) FROM enriched WHERE region_team_count < 1) AS filtered""")
register_store("jobs_per_company", """SELECT company_id, count(*) AS open_positions FROM st_upd
WHERE company_id IS NOT NULL GROUP BY company_id""")
register("member_preview", """SELECT id, company_id, name, city, country FROM team_members
QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY country NULLS FIRST, city NULLS FIRST,
  name NULLS FIRST, id) <= 12""")
register("top_jobs_cli", f"SELECT {RANKED_COLS} FROM ranked ORDER BY {ORDER_O1} LIMIT 20")
register("distinct_companies", "SELECT DISTINCT company FROM jobs")
register("enrichment_work_list", f""", wl_jobs AS (SELECT *, CASE WHEN seq % 2 = 1 THEN
    'https://' || lower(replace(company, '#', '')) || '.example.com' END AS company_website FROM jobs),
wl_first AS (SELECT company, company_website AS website FROM wl_jobs
  QUALIFY row_number() OVER (PARTITION BY company ORDER BY seq) = 1),
wl_cache AS (SELECT requested_name FROM companies WHERE CAST(id AS BIGINT) % 2 = 0
  AND enriched_at >= {AS_OF_SQL} - INTERVAL 30 DAY)
SELECT company, website, coalesce(nullif(website, ''), {s_infer_website('company')}) AS domain
FROM wl_first WHERE company NOT IN (SELECT requested_name FROM wl_cache)""")


# ------------------------------------------------------------------ ingest
EMB_CTE = f""", emb AS (
  SELECT seq // 15 AS page_id, CAST(row_number() OVER (PARTITION BY seq // 15 ORDER BY seq) - 1 AS INTEGER) AS pos,
    seq, CASE WHEN seq % 13 = 0 THEN NULL ELSE CAST(seq AS VARCHAR) END AS k,
    coalesce(CASE WHEN seq % 11 = 0 THEN NULL ELSE title END,
             CASE WHEN seq % 11 = 0 AND seq % 2 = 0 THEN NULL ELSE title END, '') AS e_title,
    CASE WHEN seq % 17 = 0 THEN 'Unknown' ELSE company END AS e_company,
    coalesce(CASE WHEN seq % 19 = 0 THEN NULL ELSE location END,
             CASE WHEN seq % 19 = 0 AND seq % 2 = 0 THEN NULL ELSE 'Taipei' END, 'Remote') AS e_location,
    coalesce(nullif(CASE WHEN seq % 2 = 0 THEN '' ELSE description END, ''), title || ' ' || location) AS e_desc,
    posted_text, title AS raw_title, location AS raw_location, company AS raw_company, description AS raw_desc,
    salary_text
  FROM jobs)"""


def s_id(company, title, location, key="NULL"):
    return (f"coalesce(nullif({key}, ''), substr(md5(lower(coalesce({company}, 'None') || ':' || "
            f"coalesce({title}, 'None') || ':' || coalesce({location}, 'None'))), 1, 16))")


register("embedded_jobs", f"""{EMB_CTE}
SELECT page_id, pos, {s_id('e_company', 'e_title', 'e_location', 'k')} AS id, e_title AS title, e_company AS company,
  e_location AS location, e_desc AS description,
  CASE WHEN coalesce(k, '') <> '' THEN 'https://www.indeed.com/viewjob?jk=' || k ELSE '' END AS url,
  {s_rule_a('posted_text')} AS posted_date,
  CASE WHEN seq % 7 = 0 OR contains(lower(e_location), 'remote') THEN 'Remote' END AS remote_type,
  CASE WHEN seq % 3 = 0 THEN CAST(50000 + seq % 100 AS DOUBLE) END AS salary_min,
  CASE WHEN seq % 3 = 0 THEN CAST(90000 + seq % 100 AS DOUBLE) END AS salary_max
FROM emb WHERE page_id % 10 NOT IN (7, 8)""")
register("page_totals", """SELECT seq // 15 AS page_id,
  CAST(CASE WHEN (seq // 15) % 10 IN (7, 8) THEN 0 ELSE count(*) + 5 END AS INTEGER) AS total_count
FROM jobs GROUP BY seq // 15""")
DOM_FIELDS = """CASE WHEN seq % 23 = 0 THEN 'Unknown' ELSE raw_company END AS d_company,
  CASE WHEN seq % 29 = 0 THEN 'Remote' ELSE raw_location END AS d_location,
  trim(regexp_replace(raw_desc, '<[^>]*>', '', 'g')) AS d_desc"""
register("dom_jobs", f"""{EMB_CTE}
SELECT page_id, pos, {s_id('d_company', 'raw_title', 'd_location', 'k')} AS id, raw_title AS title,
  d_company AS company, d_location AS location, d_desc AS description,
  CASE WHEN coalesce(k, '') <> '' THEN 'https://www.indeed.com/viewjob?jk=' || k ELSE '' END AS url,
  {s_rule_a('posted_text')} AS posted_date,
  CASE WHEN contains(lower(d_location), 'remote') THEN 'Remote' END AS remote_type
FROM (SELECT *, {DOM_FIELDS} FROM emb)""")
register("selector_jobs", f"""{EMB_CTE}
SELECT page_id, pos, {s_id('d_company', 'raw_title', 'd_location')} AS id, raw_title AS title,
  d_company AS company, d_location AS location, d_desc AS description,
  'https://www.indeed.com/rc/clk?jk=' || coalesce(k, '') AS url,
  {s_rule_b('posted_text')} AS posted_date,
  CASE WHEN contains(lower(d_location), 'remote') THEN 'Remote' END AS remote_type,
  'https://www.indeed.com/cmp/' || regexp_replace(raw_company, '[^A-Za-z0-9]', '-', 'g') AS company_website
FROM (SELECT *, {DOM_FIELDS} FROM emb)""")
register("extracted_jobs", f"""{EMB_CTE}, ex AS (
  SELECT *, trim(CASE WHEN seq % 31 = 0 THEN '  ' ELSE ' ' || raw_title || ' ' END) AS x_title,
    CASE WHEN seq % 17 = 0 THEN 'Unknown' ELSE raw_company END AS x_company,
    CASE WHEN seq % 19 = 0 THEN 'Remote' ELSE raw_location END AS x_location,
    CASE WHEN seq % 3 = 0 THEN '/viewjob?jk=' || CAST(seq AS VARCHAR)
         WHEN seq % 3 = 1 THEN nullif((SELECT url FROM jobs j2 WHERE j2.seq = emb.seq), '') END AS iu,
    CASE WHEN seq % 10 = 0 THEN CAST(60000 + seq % 7 AS DOUBLE) END AS gmin,
    CASE WHEN seq % 20 = 0 THEN CAST(80000 + seq % 7 AS DOUBLE) END AS gmax,
    {s_salary_vals('salary_text')} AS sv
  FROM emb
  WHERE page_id % 9 <> 4 AND page_id % 11 <> 5 AND (page_id % 2 = 0 OR page_id % 4 <> 3))
SELECT page_id, pos, {s_id('x_company', 'x_title', 'x_location')} AS id, x_title AS title, x_company AS company,
  x_location AS location, raw_desc AS description,
  CASE WHEN coalesce(k, '') <> '' AND coalesce(iu, '') = '' THEN 'https://www.indeed.com/viewjob?jk=' || k
       WHEN coalesce(iu, '') <> '' AND NOT starts_with(iu, 'http') THEN 'https://www.indeed.com' || iu
       ELSE coalesce(iu, '') END AS url,
  {s_rule_b('posted_text')} AS posted_date,
  CASE WHEN seq % 7 = 0 OR contains(lower(x_location), 'remote') THEN 'Remote' END AS remote_type,
  CASE WHEN seq % 5 = 0 THEN 'https://www.indeed.com/cmp/' || regexp_replace(raw_company, '[^A-Za-z0-9]', '-', 'g') || '?from=direct'
       ELSE 'https://www.indeed.com/cmp/' || regexp_replace(raw_company, '[^A-Za-z0-9]', '-', 'g') END AS company_website,
  CASE WHEN gmin IS NOT NULL THEN gmin WHEN len(sv) > 0 THEN list_min(sv) END AS salary_min,
  CASE WHEN gmin IS NOT NULL THEN coalesce(nullif(gmax, 0), gmin) WHEN len(sv) > 0 THEN list_max(sv) END AS salary_max
FROM ex WHERE x_title <> ''""")
# Pages whose number is 2 of 3 have no cards and take their payload's items.
_cols = "page_id, pos, id, title, company, location, description, url, posted_date, remote_type"
_sel = ORACLE["selector_jobs"].split(EMB_CTE, 1)[1]
_ext = ORACLE["extracted_jobs"].split(EMB_CTE, 1)[1]
_ex_cte, _ex_body = _ext.split("\nSELECT page_id, pos", 1)
_ex_cte = _ex_cte.replace("AND (page_id % 2 = 0 OR page_id % 4 <> 3)", "")
register("hybrid_jobs", f"""{EMB_CTE}{_ex_cte}
SELECT {_cols} FROM ({_sel}) WHERE (page_id % 10) % 3 <> 2
UNION ALL SELECT {_cols} FROM (SELECT page_id, pos{_ex_body}) WHERE (page_id % 10) % 3 = 2""")

# Lists with explicit nulls: a null stays null, and seq % 10 in (3, 6) is no object.
DIRTY_CTE = EMB_CTE + """, dirty AS (
  SELECT *, CASE WHEN seq % 11 <> 0 THEN raw_title END AS n_title,
    CASE WHEN seq % 17 <> 0 THEN raw_company END AS n_company,
    CASE WHEN seq % 19 <> 0 THEN raw_location END AS n_location,
    CASE WHEN seq % 10 IN (3, 6) THEN 'no object'
         WHEN posted_text IS NULL THEN 'null time'
         WHEN seq % 19 = 0 AND seq % 7 <> 0 THEN 'null location' END AS reason
  FROM emb WHERE page_id % 10 NOT IN (7, 8))"""
register("embedded_rejects", f"{DIRTY_CTE} SELECT page_id, pos, reason FROM dirty WHERE reason IS NOT NULL")
register("embedded_dirty", f"""{DIRTY_CTE}
SELECT page_id, pos, {s_id('n_company', 'n_title', 'n_location', 'k')} AS id, n_title AS title, n_company AS company,
  n_location AS location, e_desc AS description,
  CASE WHEN coalesce(k, '') <> '' THEN 'https://www.indeed.com/viewjob?jk=' || k ELSE '' END AS url,
  {s_rule_a('posted_text')} AS posted_date,
  CASE WHEN seq % 7 = 0 OR contains(lower(n_location), 'remote') THEN 'Remote' END AS remote_type,
  CASE WHEN seq % 3 = 0 THEN CAST(50000 + seq % 100 AS DOUBLE) END AS salary_min,
  CASE WHEN seq % 3 = 0 THEN CAST(90000 + seq % 100 AS DOUBLE) END AS salary_max
FROM dirty WHERE reason IS NULL""")
ORACLE["extracted_dirty"] = ORACLE["extracted_jobs"].replace(
    "WHERE page_id % 9 <> 4 AND page_id % 11 <> 5 AND (page_id % 2 = 0 OR page_id % 4 <> 3))",
    "WHERE seq % 10 NOT IN (3, 6) AND seq % 30 <> 20)")
register("search_results", f"""{EMB_CTE}, found AS (
  SELECT page_id // 10 AS s, page_id % 10 AS page_no, pos, {s_id('e_company', 'e_title', 'e_location', 'k')} AS id,
    e_title AS title FROM emb WHERE page_id % 10 NOT IN (7, 8)),
gap AS (SELECT s, min(p) AS stop FROM (SELECT DISTINCT s FROM found) CROSS JOIN range(11) t(p)
  WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.s = s AND f.page_no = p) GROUP BY s)
SELECT 'search-' || CAST(s AS VARCHAR) AS search_id, CAST(rank AS INTEGER) AS rank, id, title FROM (
  SELECT f.*, row_number() OVER (PARTITION BY s ORDER BY page_no, pos) AS rank
  FROM found f JOIN (SELECT s, min(p) AS stop FROM (
      SELECT a.s, p FROM (SELECT DISTINCT s FROM found) a CROSS JOIN range(11) t(p)
      WHERE NOT EXISTS (SELECT 1 FROM found g WHERE g.s = a.s AND g.page_no = p)) GROUP BY s) USING (s)
  WHERE page_no < stop) WHERE rank <= 50""".replace(""",
gap AS (SELECT s, min(p) AS stop FROM (SELECT DISTINCT s FROM found) CROSS JOIN range(11) t(p)
  WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.s = s AND f.page_no = p) GROUP BY s)""", ""))
# The greedy rule within each search, over the rows of its pages (embedded, else cards).
register("stream_ingest", f"""{EMB_CTE}, ing AS (
  SELECT seq, page_id // 10 AS s, {s_id('e_company', 'e_title', 'e_location', 'k')} AS real_id,
    e_company AS c, e_title AS t, k FROM emb WHERE page_id % 10 NOT IN (7, 8)
  UNION ALL SELECT seq, page_id // 10, {s_id('d_company', 'raw_title', 'd_location', 'k')},
    d_company, raw_title, k FROM (SELECT *, {DOM_FIELDS} FROM emb) WHERE page_id % 10 IN (7, 8)),
ing_jobs AS (SELECT seq, CAST(s AS VARCHAR) || 'x' || real_id AS id, real_id, TIMESTAMP '2001-01-01' AS scraped_at,
    CAST(s AS VARCHAR) || 'x' || c AS company, t AS title,
    CASE WHEN coalesce(k, '') <> '' THEN CAST(s AS VARCHAR) || 'x' || k END AS url FROM ing),
{dedup_ctes('ing_jobs')}
SELECT DISTINCT real_id AS id FROM ing_jobs SEMI JOIN dd_kept ON ing_jobs.seq = dd_kept.o
WHERE (SELECT ok FROM dd_ok)""")
register("blocked_pages", r"""SELECT *, (challenge OR captcha_phrase OR captcha_element OR blocked_element) AS blocked
FROM (SELECT page_id,
  (contains(html, 'challenges.cloudflare.com') OR contains(html, 'Verify you are human')
   OR contains(html, 'Just a moment') OR contains(html, 'cf-challenge')) AS challenge,
  (contains(lower(html), 'verify you') OR contains(lower(html), 'captcha')) AS captcha_phrase,
  (regexp_matches(html, '(?i)<(div|iframe|form)\b[^>]*\bclass\s*=\s*["''][^"'']*(recaptcha|captcha-container|hcaptcha)')
   OR regexp_matches(html, '(?i)>[^<]*(verify you.re human|solve.*captcha|complete.*verification)')) AS captcha_element,
  (regexp_matches(html, '(?i)<div\b[^>]*\bclass\s*=\s*["''][^"'']*(blocked|access.*denied)')
   OR regexp_matches(html, '(?i)<[a-z0-9]+\b[^>]*\bid\s*=\s*["''][^"'']*(blocked|access.*denied)')
   OR regexp_matches(html, '(?i)<h1\b[^>]*>[^<]*(blocked|access.*denied|unusual traffic)')) AS blocked_element,
  length(html) < 5000 AND NOT (contains(html, 'job_seen_beacon') OR contains(html, 'mosaic-provider-jobcards')) AS suspicious_small
FROM pages)""")
register("page_links", """SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, hrefs[i] AS href, texts[i] AS text
FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS hrefs,
        regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS texts FROM pages) p,
  LATERAL (SELECT unnest(generate_series(1, len(hrefs))) AS i)""")
register("page_titles", f"""SELECT page_id, {s_strip("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title,
  {s_url_domain('url')} AS host FROM pages""")
register("source_fallback", f"""{EMB_CTE}
SELECT page_id, pos, {s_id('e_company', 'e_title', 'e_location', 'k')} AS id, e_title AS title, e_company AS company,
  e_location AS location, 'embedded' AS source FROM emb WHERE page_id % 10 NOT IN (7, 8)
UNION ALL
SELECT page_id, pos, {s_id('d_company', 'raw_title', 'd_location', 'k')}, raw_title, d_company, d_location, 'dom'
FROM (SELECT *, {DOM_FIELDS} FROM emb) WHERE page_id % 10 IN (7, 8)""")


# ------------------------------------------------------------------ vendors
register("vendor_a_company", f"""SELECT {s_md5_16('lower(requested_name)')} AS id,
  CASE WHEN CAST(id AS BIGINT) % 5 = 2 THEN name || ' Inc' ELSE name END AS name, requested_name,
  'https://www.linkedin.com/company/' || id AS linkedin_url, website, industry,
  {s_size_bucket('ec')} AS company_size,
  nullif(concat_ws(', ', nullif(loc, ''), NULL, nullif(headquarters_location, '')), '') AS headquarters_location,
  'About ' || name AS description, ec AS total_employees, 'vendor_a' AS source
FROM (SELECT *, CASE WHEN CAST(id AS BIGINT) % 6 = 5 THEN NULL ELSE CAST(CAST(id AS BIGINT) * 37 % 9000 AS INTEGER) END AS ec,
        CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN '' ELSE 'City ' || CAST(CAST(id AS BIGINT) % 9 AS VARCHAR) END AS loc
      FROM companies) WHERE CAST(id AS BIGINT) % 8 <> 7""")
register("vendor_b_company", """SELECT id, name, requested_name, 'https://www.linkedin.com/company/' || id AS linkedin_url,
  CASE WHEN CAST(id AS BIGINT) % 4 = 1 THEN 'requested-' || id || '.com' ELSE website END AS website,
  industry, company_size, headquarters_location, 'About ' || name AS description,
  CAST(CAST(id AS BIGINT) * 37 % 9000 AS INTEGER) AS total_employees, 'vendor_b' AS source
FROM companies WHERE CAST(id AS BIGINT) % 8 <> 7""")
CAPPED = """capped AS (SELECT * FROM team_members WHERE country IN ('Taiwan', 'China', 'Singapore', 'Hong Kong')
  QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY id) <= 100)"""
register("vendor_a_people", f""", {CAPPED}
SELECT company_id, CAST(row_number() OVER (PARTITION BY company_id ORDER BY id) - 1 AS INTEGER) AS pos,
  name, title, location, city, coalesce({s_initcap('lower(country)')}, '') AS country, linkedin_url FROM capped""")
register("vendor_b_people", f""", {CAPPED}
SELECT company_id, CAST(row_number() OVER (PARTITION BY company_id ORDER BY id) - 1 AS INTEGER) AS pos,
  name, title, location, {s_city('location', 'country')} AS city, country, linkedin_url FROM capped""")
register("vendor_head_count", f""", {CAPPED}
SELECT company_id, CAST(count(*) AS INTEGER) AS region_team_count FROM capped GROUP BY company_id""")
register("company_metadata", """SELECT CAST(id AS BIGINT) AS page_id, name AS company_name,
  CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN NULL ELSE 'https://' || website END AS website,
  industry, company_size, headquarters_location AS headquarters FROM companies""")
EMPLOYER = """em AS (SELECT DISTINCT c.id AS company_id, p.id AS person_id, p.name, p.country
  FROM (SELECT id, name, country, 'supplier' || CAST(id % (SELECT n FROM ns) AS VARCHAR) || '.com' AS d FROM team_members
        UNION ALL SELECT id, name, country, 'supplier' || CAST((id * 7 + 3) % (SELECT n FROM ns) AS VARCHAR) || '.com' FROM team_members) p
  JOIN companies c ON c.website = p.d
  WHERE p.country IN ('Taiwan', 'China', 'Singapore', 'Hong Kong'))"""
register("employer_match", f", {EMPLOYER}\nSELECT * FROM em")
register("people_cap", f""", {EMPLOYER}
SELECT * FROM em QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY person_id) <= 100""")
register("company_websites", """SELECT CAST(id AS BIGINT) AS page_id,
  CASE WHEN CAST(id AS BIGINT) % 4 = 3 THEN NULL ELSE website END AS website FROM companies""")
register("company_page_links", """SELECT seq AS page_id, CASE
  WHEN seq % 4 = 0 THEN 'https://www.indeed.com/cmp/' || regexp_replace(company, '[^A-Za-z0-9]', '-', 'g') || '?campaignid=x'
  WHEN seq % 4 = 1 THEN 'https://www.indeed.com/cmp/' || regexp_replace(company, '[^A-Za-z0-9]', '-', 'g') END AS company_page
FROM jobs""")
register_store("digest_top10", f"""SELECT {LIST} FROM st_upd
ORDER BY region_team_count DESC NULLS LAST, posted_date DESC NULLS LAST, id LIMIT 10""")
register("saved_search", f"""SELECT seq, id, smin AS salary_min, smax AS salary_max, posted_date, region_team_count
FROM (SELECT *, CASE WHEN len(v) > 0 THEN list_min(v) END AS smin, CASE WHEN len(v) > 0 THEN list_max(v) END AS smax
      FROM (SELECT *, {s_salary_vals('salary_text')} AS v FROM enriched))
WHERE coalesce(smax, smin) >= 60000 AND {s_days('posted_date')} <= 14 AND coalesce(region_team_count, 0) >= 1""")

# ------------------------------------------- registry, flat filter, rule sets
register("vendor_people", f""", {CAPPED}
SELECT v AS vendor, company_id, CAST(row_number() OVER (PARTITION BY v, company_id ORDER BY id) - 1 AS INTEGER) AS pos, name
FROM capped, (VALUES ('a'), ('b')) t(v)""")
register("people_by_employer", """SELECT t.id, t.company_id, t.country FROM team_members t
JOIN companies c ON c.id = t.company_id WHERE c.name = 'Supplier#000000000'
  AND country IN ('Taiwan', 'China', 'Singapore', 'Hong Kong')
QUALIFY row_number() OVER (PARTITION BY t.company_id ORDER BY t.id) <= 100""")
register("company_websites_labelled", """SELECT CAST(id AS BIGINT) AS page_id,
  'https://www.linkedin.com/company/' || id AS website FROM companies""")
register("company_websites_plain", """SELECT CAST(id AS BIGINT) AS page_id,
  CASE CAST(id AS BIGINT) % 4 WHEN 0 THEN 'https://www.' || website || '/about'
       WHEN 1 THEN 'https://' || website END AS website FROM companies""")

# ----------------------------------------------- tables changed in place, flat members
register_store("merge_partitions", "SELECT * FROM c_merged")
register_store("replace_partitions", "SELECT * FROM m_out")
register_store("expire_partitions", f"""SELECT id, seq, scraped_at FROM stored
WHERE scraped_at IS NULL OR scraped_at >= {AS_OF_SQL} - INTERVAL 30 DAY""")
register_store("company_360_incremental", f"""SELECT c.id AS company_id, c.name, c.industry, c.company_size, c.region_team_count,
  coalesce(jc.n, 0) AS open_positions, coalesce(mc.n, 0) AS n_members, coalesce(mc.countries, '') AS countries
FROM companies c
LEFT JOIN (SELECT company_id, count(*) AS n FROM st_upd WHERE company_id IS NOT NULL
  AND (scraped_at IS NULL OR scraped_at >= {AS_OF_SQL} - INTERVAL 30 DAY) GROUP BY company_id) jc ON jc.company_id = c.id
LEFT JOIN (SELECT company_id, count(*) AS n, array_to_string(list_sort(list_distinct(list(country))), ',') AS countries
  FROM m_out GROUP BY company_id) mc ON mc.company_id = c.id""")
register("saved_search_types", f"""SELECT seq, id, 'Remote' AS job_type, posted_date FROM enriched
WHERE contains(lower(location), 'remote') AND {s_days('posted_date')} <= 30""")
register("enriched_team", """SELECT e.seq, e.id AS job_id, m.id AS member_id, m.name, m.title, m.city, m.country
FROM enriched e JOIN team_members m ON m.company_id = e.company_id""")
