"""F4 with the trigram index: the rows of the plain search, from the postings of the term only."""

import io
import random
import uuid
from contextlib import redirect_stdout

import pytest

from jobloom.operators import search_index as S
from jobloom.operators import serve
from jobloom.session import shared_dir

SCHEMA = "id string, title string, company string, description string, region_team_count int"
TERMS = ["ring", "RING", "100%", "a_b", "日本語", "ß é", "e", "", "ab", "zzz", "red%eng", "\\d x", "%%", "Éab",
         "engineer%remote", "o r"]


def rows(n, seed):
    rng = random.Random(seed)
    words = ["Engineer", "ring", "spring", "red", "100%", "a_b", "axb", "日本語版", "ß é", "\\d x", "Remote", "éab", "o", "r"]
    out = []
    for i in range(n):
        text = [" ".join(rng.choices(words, k=rng.randint(0, 5))) for _ in range(3)]
        if i % 9 == 0:
            text[rng.randrange(3)] = None
        out.append((f"{seed}-{i}", *text, rng.choice([None, 0, 3])))
    return out


@pytest.fixture(scope="module")
def index(spark):
    folder = shared_dir(spark, f"jobloom/test-index-{uuid.uuid4().hex}")
    first = spark.createDataFrame(rows(400, 1), SCHEMA).repartition(3)
    more = spark.createDataFrame(rows(150, 2), SCHEMA).repartition(2)
    S.add(first, folder)
    S.add(more, folder, generation=1)
    return folder, first.unionByName(more)


@pytest.mark.parametrize("q", TERMS)
def test_same_rows_as_the_plain_search(spark, index, q):
    folder, whole = index
    got = S.search(spark, folder, q, min_team=0)
    assert got.columns == whole.columns
    want = sorted(r.id for r in serve.search(whole, q).collect())
    assert sorted(r.id for r in got.collect()) == want


def test_trigrams_of_terms():
    assert S.term_trigrams("RiNg") == ["ing", "rin"] and S.term_trigrams("ab%cd_e") == []
    assert S.term_trigrams("ab%cdef") == ["cde", "def"]


def explained(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_only_the_posting_blocks_of_a_term_are_read(spark, index):
    plan = explained(S.posting_blocks(spark, index[0], ["rin", "ing"]))
    assert "PartitionFilters" in plan and "shard" in plan.split("PartitionFilters")[1][:80]
    assert "In(gram,[" in plan.replace(" ", "")              # pushed to the row groups
    files = S.posting_blocks(spark, index[0], ["rin", "ing"]).select("_metadata.file_path").distinct().count()
    assert files <= 2 * 2 * 4 < len(spark.read.parquet(f"{index[0]}/postings").inputFiles())


def test_lists_are_gaps_of_sorted_numbers(spark, index):
    blocks = spark.read.parquet(f"{index[0]}/postings").where("gram = 'rin'").collect()
    assert sum(b.n for b in blocks) == sum(
        any(c and "rin" in c.lower() for c in (r.title, r.company, r.description))
        for r in S.indexed_rows(spark, index[0]).collect())
    assert all(len(b.gaps) == b.n and min(b.gaps[1:], default=1) > 0 for b in blocks)


def test_index_without_rows(spark):
    folder = shared_dir(spark, f"jobloom/test-index-{uuid.uuid4().hex}")
    S.add(spark.createDataFrame([], SCHEMA), folder)
    for q in ("abc", "ab", ""):
        assert S.search(spark, folder, q).count() == 0


def test_index_without_trigrams(spark):
    folder = shared_dir(spark, f"jobloom/test-index-{uuid.uuid4().hex}")
    S.add(spark.createDataFrame([("1", None, "ab", "", 1)], SCHEMA), folder)
    assert S.search(spark, folder, "abc").count() == 0 and S.search(spark, folder, "ab").count() == 1


def test_postings_are_made_in_the_tasks_that_read_the_rows(spark, monkeypatch):
    """Lists leave a task whole: no row for each trigram of each document is shuffled."""
    monkeypatch.setattr(S, "RUN_CHARS", 500)                 # several runs of a block
    folder = shared_dir(spark, f"jobloom/test-index-{uuid.uuid4().hex}")
    frame = spark.createDataFrame(rows(300, 3) + [("x", "a\0bc", "😀é日x", None, 1)], SCHEMA)
    S.add(frame.coalesce(1), folder)
    lists = spark.read.parquet(f"{folder}/postings").collect()
    want = {}
    for r in S.indexed_rows(spark, folder).collect():
        for text in (r.title, r.company, r.description):
            low = "".join(c.lower() if c < "\x80" else c for c in text or "")
            for i in range(len(low) - 2):
                want.setdefault(low[i:i + 3], set()).add(r.doc)
    got = {}
    for x in lists:
        docs, at = set(), 0
        for gap in x.gaps:
            at += gap
            docs.add((x.block << S.BLOCK_BITS) + at)
        assert len(docs) == x.n and not docs & got.get(x.gram, set())
        got.setdefault(x.gram, set()).update(docs)
    assert got == want
    assert [r.id for r in S.search(spark, folder, "😀é日").collect()] == ["x"]


def test_candidates_are_bits_of_blocks(spark, index):
    found = S.candidates(spark, index[0], ["rin", "ing"]).collect()
    docs = {(f.gen, (f.block << S.BLOCK_BITS) + i) for f in found for i in range(1 << S.BLOCK_BITS)
            if f.bits[i >> 6] >> (i & 63) & 1}
    assert docs == {(r.gen, r.doc) for r in S.indexed_rows(spark, index[0]).collect()
                    if all(any(g in (c or "").lower() for c in (r.title, r.company, r.description))
                           for g in ("rin", "ing"))}
