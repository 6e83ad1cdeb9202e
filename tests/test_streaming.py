"""The streamed store doesn't depend on how landed files are grouped into batches."""

import io
import os
import uuid
from contextlib import redirect_stdout

import pytest

from jobloom.plans import base, streaming
from jobloom.session import shared_dir
from jobloom.sources import landed
from jobloom.streaming import ingest
from jobloom.streaming.ingest import dedup_searches, jobs_of_pages, run_ingest
from jobloom.streaming.searches import is_whole, state_on_disk, whole_searches
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def landing(spark):
    run = shared_dir(spark, f"jobloom/test-stream-{uuid.uuid4().hex}")
    streaming.land_pages(spark, SF_SMALL, f"{run}/landing", files=8)
    return run


def ids(spark, folder):
    rows = [r.id for r in spark.read.parquet(folder).select("id").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_any_batching_gives_the_batch_result(spark, landing):
    folder = f"{landing}/landing".removeprefix("file:")
    assert sum(n.startswith("part-") for n in os.listdir(folder)) >= 6
    pages = spark.read.parquet(f"{landing}/landing")
    spread = pages.select("search_id", "_metadata.file_path").distinct().groupBy("search_id").count()
    assert spread.where("count > 1").count() >= 6            # searches lie in several files
    want = {r.id for r in dedup_searches(jobs_of_pages(pages, base.AS_OF)).select("id").collect()}
    for files in (1, 4, 100):
        run_ingest(spark, f"{landing}/landing", f"{landing}/store{files}", f"{landing}/ckpt{files}",
                   base.AS_OF, files_per_trigger=files)
        assert ids(spark, f"{landing}/store{files}") == want and want
    # a replay of the same files adds nothing: progress is in the checkpoint, ids are known
    run_ingest(spark, f"{landing}/landing", f"{landing}/store4", f"{landing}/ckpt4", base.AS_OF)
    run_ingest(spark, f"{landing}/landing", f"{landing}/store4", f"{landing}/other", base.AS_OF, 3)
    assert ids(spark, f"{landing}/store4") == want


def test_a_search_is_whole():
    assert is_whole({0, 1, 2}, {2}) and not is_whole({0, 2}, {2}) and not is_whole({0, 1}, set())
    assert is_whole(set(range(10)), set()) and not is_whole({9}, set()) and is_whole({0}, {0})
    assert is_whole({0, 1, 5}, {1}) and is_whole({0, 1, 2}, {1, 2}) and is_whole({0, 1}, set(), cap=2)


PAGES = "page_id long, search_id string, page_no int, html string, last boolean"


def page(i, search, no, last=False):
    return (i, search, no, "x", last)


def released(spark, files, tmp, patience_ms):
    """What each run hands out when the files come one by one."""
    out = []
    for rows in files:
        spark.createDataFrame(rows, PAGES).coalesce(1).write.mode("append").parquet(f"{tmp}/in")
        out.append([])
        with state_on_disk(spark):
            src = spark.readStream.schema(PAGES).parquet(f"{tmp}/in")
            q = (whole_searches(src, patience_ms=patience_ms).writeStream.foreachBatch(
                lambda b, _: out[-1].extend((r.search_id, r.page_no) for r in b.collect()))
                .option("checkpointLocation", f"{tmp}/ckpt").trigger(availableNow=True).start())
            q.awaitTermination()
    return [sorted(x, key=str) for x in out]


FILES = [[page(1, "a", 2, True), page(2, "b", 0)],                     # the end comes first
         [page(3, "a", 0), page(4, "b", 0), page(5, None, 0, True)],   # b's page again
         [page(6, "a", 1), page(7, "c", None), page(8, "b", 1)]]       # a page without a number


def test_pages_wait_until_their_search_is_whole(spark, tmp_path):
    assert released(spark, FILES, tmp_path, 3_600_000) == [
        [], [(None, 0)], [("a", 0), ("a", 1), ("a", 2)]]


def test_lost_ends_go_out_by_the_timer(spark, tmp_path):
    files = [FILES[0][1:], [page(9, "d", 0, True)], [page(10, "b", 1)], [page(11, "e", 0, True)]]
    got = released(spark, files, tmp_path, 1)
    assert got[0] == [] and [x for g in got for x in g if x[0] == "b"] == [("b", 0), ("b", 1)]
    assert got[1] == [("b", 0), ("d", 0)] and got[3] == [("b", 1), ("e", 0)]


def explained(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_known_ids_are_read_from_the_touched_buckets(spark):
    store = shared_dir(spark, f"jobloom/test-store-{uuid.uuid4().hex}")

    def rows(keys):
        return spark.createDataFrame(
            [(k, i, *[None] * (len(ingest.STORE_SCHEMA) - 1)) for i, k in enumerate(keys)],
            "id string, seq long, " + ", ".join(
                f"{f.name} {f.dataType.simpleString()}" for f in ingest.STORE_SCHEMA.fields if f.name != "id"))
    ingest.add_to_store(spark, store, rows([f"k{i}" for i in range(500)]))
    folders = [n for n in os.listdir(store.removeprefix("file:")) if n.startswith("bucket=")]
    assert len(folders) == ingest.BUCKETS
    again = rows(["k1", "new", "new", None])
    ingest.add_to_store(spark, store, again)
    touched = [r[0] for r in again.select(ingest.bucket_of("id")).distinct().collect()]
    known = ingest.known_ids(spark, store, touched)
    plan = explained(known)
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:80]
    assert known.count() < 60
    stored = [r.id for r in spark.read.parquet(store).select("id").collect()]
    assert len(stored) == 502 and stored.count("new") == 1 and stored.count(None) == 1


def test_pages_are_parsed_before_the_sort(spark, landing, monkeypatch):
    """A sort samples its input: what it sorts has been written already."""
    written, plain = [], ingest.materialize

    def seen(df, name="stage"):
        written.append((name, explained(df)))
        return plain(df, name)
    monkeypatch.setattr(ingest, "materialize", seen)
    jobs_of_pages(spark.read.parquet(f"{landing}/landing"), base.AS_OF)
    assert [n for n, _ in written] == ["ingest-pages", "ingest"]
    assert "from_json" not in written[1][1] and "MapInArrow" in written[0][1] and "MapInArrow" not in written[1][1]


def tables(folder):
    return {n for n in os.listdir(folder) if not n.startswith("test-")} if os.path.isdir(folder) else set()


def shuffle_blocks(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {b for b in found.mkString(" ").split() if b.startswith("shuffle_")}


def test_a_batch_leaves_its_rows_only(spark, landing):
    """No written table and no shuffle file of a batch is there after it."""
    folder = shared_dir(spark, "jobloom").removeprefix("file:")
    tables_before, blocks_before = tables(folder), shuffle_blocks(spark)
    run_ingest(spark, f"{landing}/landing", f"{landing}/alone", f"{landing}/ckpt-alone", base.AS_OF, 4)
    assert ids(spark, f"{landing}/alone")
    assert tables(folder) == tables_before
    assert not {b for b in shuffle_blocks(spark) - blocks_before if not b.endswith(".checksum.ADLER32")}


def test_the_query_leaves_its_store_only(spark):
    folder = shared_dir(spark, "jobloom").removeprefix("file:")
    before = tables(folder)
    assert streaming.stream_ingest(spark, SF_SMALL).count()
    run, = tables(folder) - before
    assert [n for n in os.listdir(f"{folder}/{run}") if not n.startswith(".")] == ["store"]


def test_the_state_holds_jobs_instead_of_markup(spark, landing):
    pages = spark.read.parquet(f"{landing}/landing")
    held = ingest.parsed_pages(pages)
    assert held.columns == ["page_id", "search_id", "page_no", "last", "jobs"]
    columns = ["page_id", "pos", *ingest.STORE_COLUMNS]
    was = {tuple(r) for r in ingest.pages.jobs_or_cards(pages, base.AS_OF).select(columns).collect()}
    assert {tuple(r) for r in ingest.jobs_of_parsed(held, base.AS_OF).select(columns).collect()} == was and was
    # a page without jobs is a page of its search all the same, and odd texts come back as they were
    card = '<div class="job_seen_beacon"><h2 class="jobTitle"><a data-jk="k"><span>\u00e4 &quot;b&quot; \\c</span></a></h2></div>'
    odd = spark.createDataFrame([(1, "s", 0, None, False), (2, "s", 1, "<p>none</p>", False), (None, None, 2, card, True)], PAGES)
    held = ingest.parsed_pages(odd)
    assert [(r.page_no, r.last) for r in held.orderBy("page_no").collect()] == [(0, False), (1, False), (2, True)]
    row, = ingest.jobs_of_parsed(held, base.AS_OF).collect()
    was, = ingest.pages.jobs_or_cards(odd, base.AS_OF).collect()
    assert all(row[c] == was[c] for c in columns) and row.page_id is None and row.title == '\u00e4 "b" \\c'


def test_slices_change_nothing(spark, landing, monkeypatch):
    pages = spark.read.parquet(f"{landing}/landing")
    lost = pages.limit(1).selectExpr("CAST(NULL AS LONG) AS page_id", "'x' AS search_id", "page_no", "url", "html", "last")
    pages = pages.unionByName(lost)

    def run(name):
        found = jobs_of_pages(pages, base.AS_OF)
        kept = dedup_searches(found)
        ingest.add_to_store(spark, f"{landing}/{name}", kept)
        stored = spark.read.parquet(f"{landing}/{name}").select(ingest.STORE_SCHEMA.names).collect()
        return ([tuple(r)[1:] for r in found.select("seq", *ingest.STORE_COLUMNS).orderBy("seq").collect()],
                sorted(r.id + r.search_id for r in kept.select("id", "search_id").collect()),
                sorted(map(str, stored)), len(found.ingested), len(kept.written))
    whole = run("whole")
    monkeypatch.setattr(ingest, "SLICE_ROWS", 400)
    sliced = run("sliced")
    assert sliced[:3] == whole[:3] and whole[0][0][1] == "x"
    assert whole[3:] == (1, 1) and min(sliced[3:]) > 2
    monkeypatch.setattr(ingest, "SLICES", 2)
    assert ingest.slices_of(pages) <= 2


def test_pages_are_made_after_the_shuffle(spark):
    """What is shuffled is the jobs' columns, not their pages."""
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    try:
        plan = landed.search_pages(base.jobs(spark, SF_SMALL))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    _, _, below = plan.partition("Exchange hashpartitioning(page_id")
    assert "posted_text" in below and "job_seen_beacon" not in below
