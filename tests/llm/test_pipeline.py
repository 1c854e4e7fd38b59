"""The pipeline, stage by stage on what the one before has kept, against plain forms; and as a whole."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline as P
from habitlake.llm import votes

from . import brute
from .conftest import SF

NAMES = ["quality", "near_duplicates", "decontaminate", "redact", "mix"]


@pytest.fixture(scope="module", params=["real", "odd", "none"])
def folder(request, spark, tmp_path_factory):
    """A folder of tables: the real ones, odd documents (nulls, repeats, clashing names) with the real others, no rows."""
    if request.param == "real":
        return SF
    path = str(tmp_path_factory.mktemp(request.param))
    docs = request.getfixturevalue(request.param)
    docs.write.parquet(f"{path}/documents.parquet")
    for t in ("benchmark", "labels"):
        table = spark.read.parquet(f"{SF}/{t}.parquet")
        (table.limit(0) if request.param == "none" else table).write.parquet(f"{path}/{t}.parquet")
    return path


@pytest.fixture(scope="module")
def walked(spark, folder, tmp_path_factory):
    """[(name, rows before, rows after, columns)] of each stage."""
    root = str(tmp_path_factory.mktemp("stages"))
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in P.STAGES:
        after = stage(spark, docs, folder)
        after.write.parquet(f"{root}/{name}")
        after = spark.read.schema(after.schema).parquet(f"{root}/{name}")
        out.append((name, docs.collect(), after.collect(), after.columns, docs.columns))
        docs = after
    return {x[0]: x[1:] for x in out}


def test_stages_in_order_keep_the_columns(walked):
    assert [n for n, _ in P.STAGES] == list(walked) == NAMES
    for name in NAMES[:-1]:
        before, after, columns, had = walked[name]
        assert columns == had, name
        if name != "redact":
            assert not Counter(map(tuple, after)) - Counter(map(tuple, before)), name
    assert walked["mix"][2][-3:] == ["mix_size", "mix_target", "mix_taken"]


def test_quality_keeps_what_its_operator_predicts(spark, folder, walked):
    before, after, _, _ = walked["quality"]
    scored = votes.quality_scores(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    kept = Counter(r.doc_id for r in scored.collect() if r.predicted == 1)
    assert Counter(r.doc_id for r in after) == kept


def test_near_duplicates_leave_one_of_each_group(walked):
    before, after, _, _ = walked["near_duplicates"]
    comps = brute.components([(r.doc_id, r.text) for r in before], 5, 80)
    ids = Counter(r.doc_id for r in after)
    assert {c for _, s, c in comps if s and c is not None} <= set(ids)
    twice = {d for d, k in Counter(r.doc_id for r in before).items() if k > 1}
    assert not {d for d, s, c in comps if s and d is not None and d != c and d not in twice} & set(ids)


def test_decontaminate_drops_the_contaminated_only(spark, folder, walked):
    before, after, _, _ = walked["decontaminate"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    judged = brute.contamination([r.text for r in before], items)
    assert Counter(map(tuple, after)) == Counter(tuple(r) for r, x in zip(before, judged) if not x[-1])


def test_redact_leaves_no_base_span_and_other_texts_alone(walked):
    before, after, _, _ = walked["redact"]
    assert Counter(r.doc_id for r in before) == Counter(r.doc_id for r in after)
    assert not [r.doc_id for r in after if any(k == "email" for k, _, _ in brute.pii(r.text))]
    old = defaultdict(set)
    for r in before:
        old[r.doc_id].add(r.text)
    tags = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]")
    for r in after:
        assert r.text in old[r.doc_id] or any(t in r.text for t in tags)
        assert r.n_chars is None or r.text is None or r.text in old[r.doc_id] or r.n_chars == len(r.text)
    clean = {r.text for r in before if r.text and not brute.pii(r.text) and not any(c in r.text for c in "@+0123456789")}
    assert clean <= {r.text for r in after}


def test_mix_takes_the_words_of_the_targets(walked):
    before, after, _, _ = walked["mix"]
    sizes = defaultdict(int)
    for r in before:
        sizes[r.source] += len(brute.words(r.text))
    want, taken, each = brute.targets(sizes) if sum(sizes.values()) else {}, Counter(), Counter()
    for r in after:
        assert len(brute.words(r.text)) == r.mix_taken <= r.mix_size and abs(r.mix_target - want[r.source]) < 1e-6
        taken[r.source] += r.mix_taken
        each[r.doc_id] += r.mix_taken
    room = Counter()
    for r in before:
        room[r.doc_id] += 2 * len(brute.words(r.text))
    assert all(n <= room[d] for d, n in each.items())
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.1 * t, 64), (s, taken[s], t)


def test_run_gives_the_last_stage(spark, folder, walked):
    row = lambda r: (r.doc_id, r.source, r.text, r.mix_taken)
    got = P.run(spark, folder)
    assert got.columns == walked["mix"][2]
    assert Counter(map(row, got.collect())) == Counter(map(row, walked["mix"][1]))
