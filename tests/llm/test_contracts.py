"""Each operator against the plain form of its contract, on odd rows, on real rows and on an empty table."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from habitlake.llm import divergence, jaccard, language, licenses, mixing, pii, repeats, suffixes, tokens, votes

from . import brute
from .conftest import SF, pairs


def same(got, want):
    assert Counter(got) == Counter(want)


@pytest.fixture(params=["odd", "real", "none"])
def docs(request):
    return request.getfixturevalue(request.param)


def test_pii(docs):
    got = pii.find_pii(docs).collect()
    listed = lambda s: ",".join(f"{k}:{a}:{b}" for k, a, b in s)
    want = []
    for d, t in pairs(docs):
        s = brute.pii(t)
        want.append((d, *[sum(x[0] == k for x in s) for k in pii.KINDS], brute.sha(listed(s))))
    same([(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got], want)
    texts = defaultdict(set)
    for d, t in pairs(docs):
        texts[d] |= {listed([x]) for x in brute.pii(t)}
    for r in got:
        assert len(r.spans.split(",")) >= r.n_email + r.n_ip + r.n_card + r.n_phone


def test_pii_adds_obfuscated_forms(spark):
    """Addresses in brackets, spaced IPs, dotted cards and phones without a plus, beside plain ones and clean runs."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8)))
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card():
        d = "4" + digits(14)
        return next(d + c for c in "0123456789" if brute.luhn(d + c))

    octets = lambda: [str(rng.randint(1, 255)) for _ in range(4)]
    phone = lambda: (str(rng.randint(10, 99)), digits(2), digits(4), digits(4))
    fours = lambda d, c: c.join(d[i:i + 4] for i in range(0, 16, 4))
    plain = [lambda: f"{word()}@{word()}.org", lambda: "host " + ".".join(octets()), lambda: "card " + fours(card(), " "), lambda: "phone +" + " ".join(phone())]
    odd = [("email", "", lambda: f"{word()} (at) {word()} (dot) org"), ("ip", "host ", lambda: " . ".join(octets())), ("card", "card ", lambda: fours(card(), ".")), ("phone", "phone ", lambda: " ".join(phone()))]
    # dates, sums, codes and versions: no digits of a card or phone behind a cue, octets too large, no letters behind the @
    clean = [lambda: f"{digits(3)} {digits(4)} {digits(4)}", lambda: fours(digits(16), "."), lambda: f"{rng.randint(300, 999)} . {digits(2)} . {digits(2)} . {digits(2)}",
             lambda: f"{digits(1)} @ {digits(2)}.{digits(2)}", lambda: f"card {fours('4111111111111112', '.')}"]
    rows, planted = [], []
    for i in range(2000):
        rows.append(f"{word()} {word()} {rng.choice(plain)()} {word()}")
    for i in range(600):
        kind, cue, form = odd[i % 4]
        text, hit = f"{word()} {word()} {cue}", form()
        planted.append((len(rows), kind, len(text), len(text) + len(hit)))
        rows.append(text + hit + " " + word())
    first_clean = len(rows)
    rows += [f"{word()} {word()} {rng.choice(clean)()} {word()}" for _ in range(600)]
    got = {r.doc_id: {(x.kind, x.start, x.end) for x in r.all_spans} for r in pii.find_pii(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    for kind in pii.KINDS:
        mine = [p for p in planted if p[1] == kind]
        assert len(mine) == 150 and sum(tuple(p[1:]) in got[p[0]] for p in mine) >= 0.9 * len(mine), kind
    base = {i: set(brute.pii(rows[i])) for i in range(first_clean, len(rows))}
    assert not {rows[i] for i in base if got[i] != base[i]}


def test_pii_redaction(docs):
    out = pii.redacted(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    for r in pii.find_pii(out.select("doc_id", "text")).collect():
        assert (r.n_email, r.n_card) == (0, 0)


def test_divergence(docs):
    got = divergence.judge(docs).collect()
    want = []
    for d, t in pairs(docs):
        c = brute.base_counts(t)
        want.append((d, *c, c[0] < 10 or 100 * c[4] > 20 * c[0]))
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got], want)
    assert all(not (r.base_failed and r.kept) and r.kept is not None for r in got)


def test_divergence_judges_junk(spark, real):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = divergence.judge(real).join(labels, "doc_id").where("NOT base_failed").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in got}
    assert n.get((1, True), 0) >= 0.97 * (n.get((1, True), 0) + n.get((1, False), 0))
    assert n.get((0, False), 0) >= 0.7 * (n.get((0, True), 0) + n.get((0, False), 0))


@pytest.mark.parametrize("sizes", [{}, {"shard_phrases": 3, "group_bytes": 2000}])
def test_repeats(docs, sizes):
    rows = pairs(docs)
    want = [(d, *x) for (d, _), x in zip(rows, brute.repeats([t for _, t in rows]))]
    same([tuple(r) for r in repeats.drop_repeats(docs, **sizes).collect()], want)


def test_repeats_counts_a_place_in_one_shard(spark):
    """Shared passages in differing contexts: windows at a passage's edge are unique and hold phrases of several owners."""
    import random
    rng = random.Random(11)
    say = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    passages = [say(60) for _ in range(5)]
    texts = [" ".join(w for p in rng.sample(passages, 2) for w in (*say(rng.randint(5, 40)), *p)) + " " + " ".join(say(20)) for _ in range(400)]
    rows = list(enumerate(texts))
    want = [(d, *x) for (d, _), x in zip(rows, brute.repeats(texts))]
    same([tuple(r) for r in repeats.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"), shard_phrases=20, group_bytes=20000).collect()], want)


def test_repeats_automaton_has_no_wide_node():
    """Thousands of first words: no node has a child for each (children are searched one by one), and a stream gives the
    places of the phrases, words of no phrase and other beginnings between them."""
    rng = random.Random(5)
    phrases = [np.array([rng.randrange(1 << 31) for _ in range(repeats.PHRASE)], np.int32) for _ in range(3000)]
    automaton, symbols = repeats._automaton([p.tobytes() for p in phrases])
    _, edges, _ = automaton.dump()
    assert max(Counter(e[0] for e in edges).values()) < 200
    stream, want = [], []
    for p in phrases[:200]:
        stream += [rng.randrange(1 << 31) for _ in range(rng.randrange(3))] + p[:rng.randrange(repeats.PHRASE)].tolist()
        want.append(len(stream))
        stream += p.tolist()
    ends = [e for e, _ in automaton.iter(symbols(np.array(stream, np.int64)))]
    assert [e // repeats.PARTS - (repeats.PHRASE - 1) for e in ends] == want


def test_repeats_least_is_the_first_of_equals():
    rng = np.random.default_rng(3)
    for n, top in ((24, 2), (25, 1), (400, 3), (400, 1 << 60)):
        grams = rng.integers(0, top, n).astype(np.uint64)
        want = [i + int(grams[i:i + 24].argmin()) for i in range(n - 23)]
        assert repeats._least(grams).tolist() == want


@pytest.mark.parametrize("block", [8 << 20, 2000])
def test_contamination(spark, docs, block):
    rows = pairs(docs)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items += [(None, "two words"), (90001, "one"), (90002, None), (90003, ""), (90004, "one")]
    if rows:
        long = max((t for _, t in rows if t), key=len).split()
        items += [(90005, " ".join(long[100:130])), (90005, " ".join(long[3:20]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = suffixes.find_contamination(docs, bench, block)
    got = found.select("_row.doc_id", "n_words", "n_hit", F.size("items").alias("k"), F.sha2(F.concat_ws(",", "items"), 256).alias("h"), "contaminated").collect()
    same([tuple(r) for r in got], [(d, *x) for (d, _), x in zip(rows, brute.contamination([t for _, t in rows], items))])
    assert suffixes.decontaminated(docs, bench).columns == docs.columns


@pytest.mark.parametrize("block", [8 << 20, 700])
def test_longest_match_of_all_items(spark, block):
    """Items that share windows and go on in different ways, repeat passages, are short, or have no id."""
    rng = random.Random(block)
    say = lambda k: [f"w{rng.randrange(9)}" for _ in range(k)]
    stems = [[f"s{j}_{i}" for i in range(14)] for j in range(4)]
    items = [(i, " ".join(rng.choice(stems) + say(rng.randrange(6)) + rng.choice(stems) + [f"z{k}" for k in range(rng.randrange(20))])) for i in range(40)]
    items += [(None, items[3][1]), (77, items[3][1]), (78, "s0_0 s0_1"), (None, "s1_0"), (1, " ".join(stems[0] + ["aa"])), (2, " ".join(stems[0] + [f"z{k}" for k in range(20)]))]
    rows = [(i, " ".join(say(3) + rng.choice(stems) + say(rng.randrange(6)) + rng.choice(stems) + [f"z{k}" for k in range(rng.randrange(24))] + say(2))) for i in range(80)]
    rows += [(100, "s0_0 s0_1"), (101, None), (102, items[5][1] + " " + items[5][1]), (103, "x " + items[-1][1])]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = suffixes.find_contamination(docs, bench, block).select("_row.doc_id", "longest_match.words", "longest_match.item_id", "longest_match.first_word")
    want = [(d, *m) for (d, _), m in zip(rows, brute.longest_match([t for _, t in rows], items))]
    assert max(m[1] or 0 for m in want) > 33
    same([tuple(r) for r in got.collect()], want)


def test_contamination_of_nothing(spark, odd):
    assert not suffixes.contamination_report(odd, spark.createDataFrame([], "item_id long, text string")).where("n_hit > 0").count()


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_jaccard(docs, n, percent):
    got = [tuple(r) for r in jaccard.link_components(docs, n, percent).collect()]
    same(got, brute.components(pairs(docs), n, percent))


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80), (1, 60)])
def test_jaccard_of_many_near_copies(spark, monkeypatch, n, percent):
    """Near copies that differ in 0 to 15 words at chance places, chains of copies of copies, and a passage that texts
    of all lengths share; posting lists are dealt to parts of two groups."""
    monkeypatch.setattr(jaccard, "LIST_PART", 2)
    rng = random.Random(n)
    say = lambda k: [f"w{rng.randrange(5000)}" for _ in range(k)]

    def edit(words, k):
        out = list(words)
        for _ in range(k):
            out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
        return out

    base, passage = say(150), say(40)
    texts = [edit(base, rng.randrange(16)) for _ in range(120)]
    for _ in range(3):
        chain = say(60)
        for _ in range(25):
            texts.append(chain)
            chain = edit(chain, 1) + (["tail"] if rng.random() < 0.2 else [])
    texts += [say(k) + passage + say(k // 2) for k in range(60)] + [list(reversed(passage))] * 3
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    want = brute.components(pairs(docs), n, percent)
    assert 20 < len({c for _, _, c in want}) < len(texts) - 20
    same([tuple(r) for r in jaccard.link_components(docs, n, percent).collect()], want)


def test_one_of_each(docs):
    kept = jaccard.one_of_each(docs, 5, 80)
    assert kept.columns == docs.columns
    comps = brute.components(pairs(docs), 5, 80)
    want = {c for d, s, c in comps if s and c is not None}
    ids = {r.doc_id for r in kept.collect()}
    assert want <= ids
    twice = {d for d, k in Counter(d for d, _ in pairs(docs)).items() if k > 1}
    assert not {d for d, s, c in comps if s and d != c and d not in twice} & (ids - {None})


def test_mixture(docs):
    got = mixing.mix(docs).collect()
    rows = docs.select("doc_id", "text", "source").collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len(brute.words(r.text))
    want = brute.targets(sizes)
    same([(r.doc_id, r.size, r.source_size, round(r.target, 6)) for r in got],
         [(r.doc_id, len(brute.words(r.text)), sizes[r.source], round(want[r.source], 6)) for r in rows])
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    taken = defaultdict(int)
    for r in got:
        taken[(r.source_size, round(r.target, 6))] += r.taken
    several = Counter((sizes[s], round(want[s], 6)) for s in sizes)
    for (size, target), t in taken.items():
        assert abs(t - target * several[(size, target)]) <= 3 * mixing.BLOCK * several[(size, target)]
    same([tuple(r) for r in mixing.mix(docs).collect()], [tuple(r) for r in got])


def test_mixture_rows(docs):
    out = mixing.mixture(docs)
    assert out.columns == [*docs.columns, "mix_size", "mix_target", "mix_taken"]
    assert out.where("mix_taken <= 0 OR mix_taken > 2 * mix_size").count() == 0


def test_mixture_emits_what_it_takes(docs):
    """Words a source has in the output against its target, and each row's text against the document's."""
    rows = docs.select("doc_id", "text", "source").collect()
    sizes, texts = defaultdict(int), defaultdict(set)
    for r in rows:
        sizes[r.source] += len(brute.words(r.text))
        texts[(r.doc_id, r.source)].add(r.text)
    got, emitted, passes = mixing.mixture(docs).collect(), defaultdict(int), Counter()
    for r in got:
        w = brute.words(r.text)
        assert len(w) == r.mix_taken
        emitted[r.source] += len(w)
        passes[(r.doc_id, r.source, r.mix_size)] += 1
        if r.mix_taken == r.mix_size:
            assert r.text in texts[(r.doc_id, r.source)]
        else:
            left = [iter(brute.words(t)) for t in texts[(r.doc_id, r.source)]]
            assert r.n_chars == len(r.text) and any(all(x in words for x in w) for words in left)
    for source, target in brute.targets(sizes).items():
        assert abs(emitted[source] - target) <= 3 * mixing.BLOCK
    listed = Counter((r.doc_id, r.source, len(brute.words(r.text))) for r in rows)
    assert all(n <= mixing.MOST * listed[k] for k, n in passes.items())
    again = mixing.mix(docs).collect()
    assert sum(r.mix_taken for r in got) == sum(r.taken for r in again)


@pytest.mark.parametrize("seed", range(4))
def test_apportionment(spark, seed):
    import random
    rng = random.Random(seed)
    votes_ = {i: rng.choice([0, 1, 7, 7, rng.randint(1, 5000)]) for i in range(rng.randint(1, 30))}
    for seats in (0, 1, 5, 400):
        df = spark.createDataFrame([(i, float(v)) for i, v in votes_.items()], "k long, v double")
        got = {r.k: r.quota for r in mixing.apportion(df, "k", "v", F.lit(seats), "k").collect()}
        assert got == (brute.sainte_lague(votes_, seats) if any(votes_.values()) else dict.fromkeys(votes_, 0))


def test_language(docs):
    got = language.identify(docs).collect()
    assert len(got) == docs.count()
    langs = {r.lang for r in docs.select("lang").distinct().collect()} - {None} | {"und"}
    for r in got:
        assert r.lang_pred in langs and 0 <= r.score <= 1
    text = dict(pairs(docs.dropDuplicates(["doc_id"])))
    if len(got) > 100:
        true = {r.doc_id: r.lang for r in docs.collect()}
        held = [r for r in got if r.held_out and true[r.doc_id]]
        assert sum(r.lang_pred == true[r.doc_id] for r in held) >= 0.95 * len(held)
    for r in got:
        t = text.get(r.doc_id)
        if r.doc_id is not None and Counter(d for d, _ in pairs(docs))[r.doc_id] == 1 and not any(c.isalpha() for c in t or ""):
            assert r.lang_pred == "und"


def test_licenses(docs):
    got = licenses.scan(docs).collect()
    same([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], [(d, *brute.license_base(t)) for d, t in pairs(docs)])
    for r in got:
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_join_is_exact(docs):
    """Blocks and containment by counting all pairs."""
    want = []
    for d, t in pairs(docs):
        labels, best, blocks = set(), 0.0, 0
        for line in (t or "").split("\n"):
            block = set(brute.plain_words(line))
            hits = [(label, len(block & set(x.split())) / len(set(x.split()))) for label, x in licenses.TEMPLATES]
            hits = [x for x in hits if x[1] >= licenses.THRESHOLD - 1e-9]
            blocks += bool(hits)
            labels |= {x[0] for x in hits}
            best = max([best, *(x[1] for x in hits)])
        base = set(brute.license_base(t)[4].split(",")) - {""}
        want.append((d, ",".join(sorted(base | labels)), 1.0 if base else best, blocks))
    same([(r.doc_id, r.labels, r.score, r.n_blocks) for r in licenses.scan(docs).collect()], want)


def test_quality(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = votes.quality_scores(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert votes.keep_good(docs, labels).columns == docs.columns
    if len(got) > 100:
        true = {r.doc_id: r.quality for r in labels.collect()}
        held = [r for r in got if r.held_out and r.doc_id in true]
        assert sum(r.predicted == true[r.doc_id] for r in held) >= 0.9 * len(held)


def test_quality_without_labels(spark, odd):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in votes.quality_scores(odd, empty).collect()} == {0.5}


def test_tokens(docs):
    pieces = tokens.load()

    def best(w):
        s, n = [0.0] + [float("-inf")] * len(w), [0] * (len(w) + 1)
        for i in range(1, len(w) + 1):
            for j in range(i):
                p = pieces.score.get(w[j:i])
                if p is not None and (s[j] + p > s[i] or s[j] + p == s[i] and n[j] + 1 < n[i]):
                    s[i], n[i] = s[j] + p, n[j] + 1
        return n[len(w)]

    import re
    cut = re.compile(rb" ?[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+?(?= [^\x20\x09-\x0D])|[\x20\x09-\x0D]+")
    want = []
    for d, t in pairs(docs):
        t = (t or "").encode()
        parts = cut.findall(t)
        assert b"".join(parts) == t
        want.append((d, len(t), len(parts), sum(best(p) for p in parts)))
    same([tuple(r) for r in tokens.count_tokens(docs).collect()], want)


def test_digest_of_nothing():
    assert hashlib.sha256(b"").hexdigest() == brute.sha("")


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_parity_sketch_keeps_every_link(spark, percent):
    import numpy as np
    rng = np.random.default_rng(percent)
    sets = [np.unique(rng.integers(0, 2**63, size, dtype=np.uint64)) for size in (1, 3, 63, 64, 65, 120, 130, 700)]
    sets += [np.unique(np.concatenate([s[int(len(s) * share):], rng.integers(0, 2**63, extra, dtype=np.uint64)]))
             for s in sets for share in (0.0, 0.05, 0.2, 0.5) for extra in (0, 1, 4, 60)]
    sets = [s for s in sets if len(s)]
    nodes = spark.createDataFrame([(bytes([i]), len(s), [int(w) for w in jaccard.parity_sketch(s)]) for i, s in enumerate(sets)], "node binary, n long, parity array<long>")
    pairs = spark.createDataFrame([(bytes([i]), bytes([j])) for i in range(len(sets)) for j in range(len(sets)) if i != j], "a binary, b binary")
    left = {(r.a[0], r.b[0]) for r in jaccard._near(pairs, nodes, percent).collect()}
    similar = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets)
               if i != j and 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b))}
    assert similar and similar <= left < {(i, j) for i in range(len(sets)) for j in range(len(sets)) if i != j}


def plain_distance(p, q):
    """Jensen-Shannon distance (base 2) of two histograms."""
    import math
    keys = set(p) | set(q)
    part = lambda a: sum(a.get(k, 0) * math.log2(2 * a.get(k, 0) / (p.get(k, 0) + q.get(k, 0))) for k in keys if a.get(k, 0) > 0)
    return math.sqrt(max((part(p) + part(q)) / 2, 0))


def test_divergence_of_many_languages(spark):
    """40 languages of their own words and letters: clean documents of all of them are kept, also of the smallest;
    word distances are those of plain histograms over each language's common words."""
    import random
    rng = random.Random(4)
    rows, says = [], {}
    for n in range(40):
        letters = [chr(0x100 + 3 * n + k) if n % 2 else chr(97 + (n + 5 * k) % 26) for k in range(6)]
        says[f"l{n}"] = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) + (f"{n}" if n % 3 == 0 else "") for _ in range(40)]
        for i in range(8):
            rows.append((n * 100 + i, " ".join(rng.choice(says[f"l{n}"]) for _ in range(120 - n)), f"l{n}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in divergence.judge(df).collect()}
    assert len(got) == 320 and all(r.kept for r in got.values() if not r.base_failed) and sum(r.base_failed for r in got.values()) == 0
    for lang in ("l0", "l35", "l39"):
        mine = [t.split() for _, t, x in rows if x == lang]
        total = Counter(w for t in mine for w in t)
        whole = {w: c / sum(total.values()) for w, c in total.items()}
        for d, t, x in rows:
            if x == lang:
                p = {w: c / len(t.split()) for w, c in Counter(t.split()).items()}
                want = plain_distance(p, whole)
                if want <= divergence.MAX_WORD_DISTANCE:
                    assert abs(got[d].word_distance - want) < 1e-6, (lang, got[d].word_distance, want)


def test_texts_without_a_pair_are_not_shuffled(spark):
    """In front of the join that fetches texts, rows of ids that are not wanted go; no wanted one does, nor a null id."""
    from habitlake.llm import jaccard
    rows = spark.range(20000).selectExpr("nullif(id, 7) AS _id", "concat('text ', id) AS text")
    wanted = spark.range(0, 20000, 500).selectExpr("nullif(id, 500) AS doc_id")
    got = jaccard._among(rows, "_id", wanted).collect()
    assert all(r.text == f"text {7 if r._id is None else r._id}" for r in got)
    ids = [r._id for r in got]
    assert {None, *range(0, 20000, 500)} - {500} <= set(ids) and 40 <= len(ids) <= 60
    assert jaccard._among(rows, "_id", wanted.limit(0)).count() == 0
    plan = jaccard._among(rows, "_id", wanted)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Repartition" not in plan


def test_rows_that_stay_are_not_shuffled(spark):
    """Only rows whose id goes, or is repeated, meet a join; the others are kept whole as they are read."""
    from habitlake.llm import jaccard
    texts = [(i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(3000)]
    texts += [(5000 + i, texts[7 * i][1]) for i in range(200)] + [(1, "another text of id one"), (1, "another text of id one"), (None, texts[0][1]), (None, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = jaccard.one_of_each(docs, 5, 80)
        plan = kept._jdf.queryExecution().optimizedPlan()
        whole = [x for x in iter_plan(plan) if x.nodeName() == "Join"]
        # no input of a join but those behind the bit table has the texts
        assert all("ArrowEvalPython" in x.toString() for x in whole if "text#" in x.toString())
        assert len(whole) and "ArrowEvalPython" in plan.toString()
        parts = [plan.children().apply(i) for i in range(plan.children().size())]
        assert any("Join" not in x.toString() and "text#" in x.toString() for x in parts)
        got = Counter((r.doc_id, r.text) for r in kept.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    want = Counter(t for t in texts if t[0] is None or t[0] < 5000)
    want[(1, "another text of id one")] = 1
    assert got == want


def iter_plan(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from iter_plan(plan.children().apply(i))
