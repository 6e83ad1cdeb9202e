from collections import Counter

import corpus_pipeline as C
from jobloom.llm.packing import spans
from jobloom.llm.quality_rules import apply_rules
from tests.conftest import SF_SMALL

from .odd import WORD, empty, frame, rows
from .test_near_dups import brute as classes
from .test_packing import check
from .test_substring_dedup import brute as repeats


def test_stages_in_order():
    assert [n for n, _ in C.STAGES] == ["quality_rules", "near_dedup", "substring_dedup",
                                        "source_mixing", "best_fit_packing"]
    assert C.ORACLE_SQL is None and spans(3, 8)


def tuples(df):
    return [tuple(r) for r in df.collect()]


def test_each_stage_against_brute_force(spark):
    from tokenizers import Tokenizer

    from jobloom.llm.packing import default_tokenizer
    from jobloom.llm.scratch import Scratch
    scratch = Scratch(spark, "test-pipeline")
    docs = scratch.keep(frame(spark, rows(n=80, long_words=9000)), "docs")
    names = docs.columns
    stages = dict(C.STAGES)
    start = tuples(docs)
    good = {r.doc_id for r in apply_rules(docs).where("kept").collect()}
    one = scratch.keep(stages["quality_rules"](spark, docs, ""), "1")
    assert one.columns == names
    assert Counter(tuples(one)) == Counter(r for r in start if r[0] in good)
    two = scratch.keep(stages["near_dedup"](spark, one, ""), "2")
    kept = tuples(one)
    want = Counter({r: 1 for r, (_, named) in zip(kept, classes(kept)) if named == r[0]})
    assert Counter(tuples(two)) == want and two.columns == names
    three = scratch.keep(stages["substring_dedup"](spark, two, ""), "3")
    cut = Counter((d, tuple(x for x, y in zip(w, g) if not y)) for d, w, g in repeats(tuples(two)))
    got = tuples(three)
    assert Counter((r[0], tuple(WORD.findall(r[1]))) for r in got) == Counter(
        {k: v for k, v in cut.items() if k[1]})
    assert all(r[4] == len(r[1]) for r in got) and three.columns == names
    four = scratch.keep(stages["source_mixing"](spark, three, ""), "4")
    times = Counter(tuples(four))
    assert set(times) <= set(got) and max(times.values()) <= 3 and four.columns == names
    five = stages["best_fit_packing"](spark, four, "").collect()
    check(five, tuples(four), Tokenizer.from_file(default_tokenizer()), 2048)


def test_empty_and_whole_run(spark):
    docs = empty(spark)
    for _, stage in C.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
        docs = empty(spark)
    got = C.run(spark, SF_SMALL)
    assert {"doc_id", "sequence_id", "offset"} <= set(got.columns) and got.count() > 100
