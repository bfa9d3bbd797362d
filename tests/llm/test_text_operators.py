"""Quality rules, SimHash, SentencePiece and decontamination against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from deltaweave.llm import decontamination, quality_rules, sentencepiece_bpe, simhash

ODD = [
    (1, None, None), (2, "", "en"), (3, " \n\t ", "en"), (4, "one", "en"), (5, "two words", None), (5, "two words", None), (None, "no id here", "en"), (7, "x " * 30000, "en"), (8, "é漢𐍈\x00 ▁ a  b", "zz"), (9, "a b a b a b c", "en"),
]
SCHEMA = "doc_id long, text string, lang string"


def documents(spark, rows=ODD):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({n: F.lit("x") for n in ("fp", "n", "kept", "words", "source", "component_id", "ids")})


def sf_documents(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


# --- quality rules --------------------------------------------------------------------------------


def plain_counts(text):
    import re

    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w, n in collections.Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab #|\n\t\x0bé", max_size=60))
def test_rule_counts(text):
    t = quality_rules.Text(text)
    assert (t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words) == plain_counts(text)


def test_op8(spark, sf_dir):
    texts = sf_documents(spark, sf_dir)
    for r in quality_rules.op8_quality_rules(spark, sf_dir).collect():
        n, *rest = plain_counts(texts[r["doc_id"]])
        failed = n < 50 or 100 * rest[-1] > 50 * n
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, *rest)
        assert r["base_failed"] == failed and not (failed and r["kept"])
        assert failed or r["kept"] == all(not rule.rejects(quality_rules.Text(texts[r["doc_id"]])) for rule in quality_rules.RULES)


def plain_kept(text):
    """The rules once more, written out by their definitions."""
    import re

    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    n, chars, symbols, dup, covered = plain_counts(text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    stripped = [x.strip(" \t\n\x0b\x0c\r") for x in lines]
    cased = [c for c in text if c != c.lower() or c != c.upper()]
    return (
        n >= 50 and 100 * covered <= 50 * n and symbols <= 0.1 * n and 2 <= chars / n <= 15 and dup <= 0.5 * len(lines) and sum(x.endswith(("...", "…")) for x in stripped) <= 0.3 * len(lines)
        and sum(x.startswith(("-", "*", "•", "‣", "●")) for x in stripped) <= 0.9 * len(lines) and sum(any(c.isalpha() for c in w) for w in words) >= 0.6 * n and sum(c != c.lower() for c in text) <= 0.6 * max(len(cased), 1)
    )


CAPITALS = " ".join(f"WORD{k} IS{k * 7} LOUD{k * 3}" for k in range(30))


@pytest.mark.parametrize("more", ["", " ß", " İ", " ŉ ǰ", " ﬁ"])
def test_capitals_are_counted_one_by_one(more):
    t = quality_rules.Text(CAPITALS + more)
    assert quality_rules.cascade(t, list(quality_rules.RULES)) == "upper_case" and not plain_kept(CAPITALS + more)
    assert quality_rules.cascade(quality_rules.Text(CAPITALS.lower() + more), list(quality_rules.RULES)) is None and plain_kept(CAPITALS.lower() + more)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abcdeABCD ß#İ.…-*1\n\u00a0", min_size=1, max_size=12), min_size=40, max_size=80))
def test_verdicts_against_plain_rules(parts):
    text = " ".join(parts)
    assert (quality_rules.cascade(quality_rules.Text(text), list(quality_rules.RULES)) is None) == plain_kept(text)


def test_kept_against_plain_rules(spark):
    sf = "/root/testdata/sf0.01"
    texts = sf_documents(spark, sf)
    rows = quality_rules.op8_quality_rules(spark, sf).collect()
    assert len({r["kept"] for r in rows}) == 2 and all(r["kept"] == plain_kept(texts[r["doc_id"]]) for r in rows)


def test_sample_is_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(k, ("word%d " % k) * (60_000 if k % 2 else 60)) for k in range(400)], "doc_id long, text string")
    seen = []
    monkeypatch.setattr(quality_rules, "order_rules", lambda texts, rules: seen.extend(texts) or [(r, 0.0, 0.0) for r in rules])
    assert quality_rules.plan(docs, sample_rows=20) == [r.name for r in quality_rules.RULES]
    assert 0 < len(seen) <= 20 and max(map(len, seen)) <= quality_rules.SAMPLE_CHARS


def test_rules_keep_good_and_drop_bad(spark, sf_dir):
    found = quality_rules.op8_quality_rules(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("n_words >= 50")
    assert found.where("quality = 1 and not kept").isEmpty() and found.where("quality = 0 and kept").isEmpty()


def test_cascade_order():
    calls = collections.Counter()

    def rule(name, share, cost):
        def rejects(t):
            calls[name] += 1
            clock[0] += cost
            return int(t.text) % 100 < share

        return quality_rules.Rule(name, rejects)

    clock = [0.0]
    rules = (rule("dear", 60, 9.0), rule("cheap", 30, 1.0), rule("useless", 0, 0.5))
    order = quality_rules.order_rules([str(k) for k in range(100)], rules, lambda: clock[0])
    assert [r.name for r, _, _ in order] == ["cheap", "dear", "useless"]
    assert order[1][2] == pytest.approx(30 / 70)  # measured on what the first rule left
    calls.clear()
    assert quality_rules.cascade(quality_rules.Text("5"), [r for r, _, _ in order]) == "cheap" and calls == {"cheap": 1}


def test_rule_edges(spark):
    docs = documents(spark)
    rows = quality_rules.counts_and_verdicts(docs).collect()
    assert len(rows) == len(ODD) and not any(r["kept"] for r in rows)
    assert {r["doc_id"]: r["n_words"] for r in rows} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 2, None: 3, 7: 30000, 8: 4, 9: 7}
    assert quality_rules.counts_and_verdicts(docs.limit(0)).count() == 0
    assert quality_rules.keep_clean(docs).columns == docs.columns
    assert quality_rules.verdicts(docs).where("failed_rule is null").isEmpty()


# --- SimHash ---------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = bytes((text or ""), "utf-8").lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """{row: least id}, by comparing all pairs."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, least.get(find(i))) for i, (d, _) in enumerate(prints)]


def test_op9(spark, sf_dir):
    prints = [(d, plain_fingerprint(t)) for d, t in sf_documents(spark, sf_dir).items()]
    found = simhash.op9_simhash(spark, sf_dir).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in found} == {d: f"{f:016x}" for d, f in prints}
    assert sorted((r["doc_id"], r["component_id"]) for r in found) == sorted(plain_components(prints))


def test_links_of_crowded_fingerprints(spark):
    """A ball of near fingerprints, chains of two-bit steps and random ones."""
    rng = random.Random(5)
    centre, prints = rng.getrandbits(64), set()
    for _ in range(150):
        prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))))
    step = rng.getrandbits(64)
    for _ in range(30):
        step ^= sum(1 << b for b in rng.sample(range(64), 2))
        prints.add(step)
    prints |= {rng.getrandbits(64) for _ in range(50)}
    prints = sorted(prints)
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()}
    want = dict(plain_components(list(zip(signed, prints))))
    groups, expected = collections.defaultdict(set), collections.defaultdict(set)
    for x in signed:
        groups[roots.get(x, x)].add(x)
        expected[want[x]].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_simhash_edges(spark):
    docs = documents(spark)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ODD)
    zero = [r for r in rows if r["fp"] == 0]
    assert {r["doc_id"] for r in zero} == {1, 2, 3} and {r["component_id"] for r in zero} == {1}
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 4, 5, None, 7, 8, 9]))


GROUP = "alpha beta gamma delta epsilon zeta eta theta iota kappa "


def test_keep_one_judges_rows(spark):
    a, b = GROUP * 4, "one two three four five six seven eight nine ten " * 4
    rows = [(1, a), (5, a), (5, b), (7, b), (None, a), (None, "zzz unique text here"), (9, "c d e"), (9, "c d e"), (None, "q r s"), (None, "q r s")]
    left = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, left)) == sorted(f"Row(doc_id={i}, text={t!r})" for i, t in [(1, a), (5, b), (None, "zzz unique text here"), (9, "c d e"), (None, "q r s")])


def test_hot_fingerprints_are_sent(spark):
    """A third of the rows are copies of one text: their join is no shuffle of them."""
    rows = [(k, GROUP * 4 if k % 3 == 0 else f"text number {k} is " + " ".join(f"w{k * j % 997}" for j in range(30))) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = simhash.near_duplicates(df)
    assert sorted((r["doc_id"], r["component_id"]) for r in found.collect()) == sorted(plain_components([(d, plain_fingerprint(t)) for d, t in rows]))
    assert simhash.hot_size(100) == simhash.HOT_ROWS and simhash.hot_size(10**12) * simhash.MAX_SENT_IDS >= 10**12
    left = {r["doc_id"] for r in simhash.keep_one(df).collect()}
    assert left == {c for _, c in plain_components([(d, plain_fingerprint(t)) for d, t in rows])}


def test_variants_of_few_classes_a_task(spark, monkeypatch):
    from pyspark.sql import functions as F

    frame, dealt = type(spark.range(1)), []
    deal = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, n, *keys: dealt.append(n) or deal(self, n, *keys))
    partner = F.when(F.col("id") < 100, F.col("id") % 2).otherwise(0)
    fps = spark.range(10_000).select(F.xxhash64(F.col("id") - partner).bitwiseXOR(partner).alias("fp"))
    assert simhash.links(fps).count() == 50
    assert 10_000 / dealt[0] <= 5_000


def test_slices():
    import pyarrow as pa

    from deltaweave.llm import worker

    texts = ["x" * n for n in (5, 0, worker.SLICE_BYTES * 2, 7)] + ["y" * 1000] * 20_000
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])
    parts = list(worker.slices(iter([batch, batch.slice(0, 0)])))
    assert [x for p in parts for x in p.column(0).to_pylist()] == texts
    assert all(p.num_rows <= 1 or p.nbytes <= worker.SLICE_BYTES for p in parts)


# --- SentencePiece ----------------------------------------------------------------------------------


def same(text):
    e = sentencepiece_bpe.encoder()
    ids = np.frombuffer(e.encode(text), "<u4").tolist()
    assert ids == e.sp.encode(text or "", add_bos=True, add_eos=True)
    assert e.decode(e.encode(text)) == e.sp.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("athein ▁\n\té€𐍈語!#.=0<s>\x00")), max_size=80))
def test_encoding_of_odd_texts(text):
    same(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_encoding_of_any_text(text):
    same(text)


def test_pairs():
    e, rng = sentencepiece_bpe.encoder(), random.Random(2)
    whole = [i for i in range(len(e.pieces)) if e.alone[i]]
    for _ in range(3000):
        a, b = rng.choice(whole), rng.choice(whole)
        assert e.compatible(a, b) == (e.merge(e.pieces[a] + e.pieces[b]) == [a, b])


def test_memo_is_bounded_and_loses_nothing(monkeypatch):
    monkeypatch.setattr(sentencepiece_bpe, "MAX_WORDS", 40)
    monkeypatch.setattr(sentencepiece_bpe, "MAX_CHUNKS", 30)
    monkeypatch.setattr(sentencepiece_bpe, "MARKS", 128)
    e, rng = sentencepiece_bpe.PrefixTableEncoder(sentencepiece_bpe.default_model()), random.Random(4)
    once = " ".join(f"once{k}" for k in range(30))
    e.encode(once)
    assert not e.words and not e.chunks  # a word met once isn't kept
    for _ in range(200):
        text = " ".join(f"w{int(rng.expovariate(0.02))}," for _ in range(30))
        assert np.frombuffer(e.encode(text), "<u4").tolist() == e.sp.encode(text, add_bos=True, add_eos=True)
        assert len(e.words) <= 40 and len(e.older) <= 40 and len(e.chunks) <= 30
    assert e.words and e.older


def test_op5(spark, sf_dir):
    sp = sentencepiece_bpe.encoder().sp
    texts = sf_documents(spark, sf_dir)
    for r in sentencepiece_bpe.op5_sentencepiece(spark, sf_dir).collect():
        ids = sp.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_sentencepiece_edges(spark):
    docs = documents(spark)
    rows = sentencepiece_bpe.encode(docs).collect()
    assert [list(r["ids"]) for r in rows if r["doc_id"] in (1, 2)] == [[1, 2], [1, 2]]
    assert {r["doc_id"]: r["decoded"] for r in rows}[9] == "a b a b a b c"
    assert sentencepiece_bpe.digests(docs.limit(0)).count() == 0 and sentencepiece_bpe.digests(docs).count() == len(ODD)


# --- decontamination -------------------------------------------------------------------------------


def plain_distance(item, words):
    """Least edit distance of the item to a stretch of the words."""
    row = [0] * (len(words) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(words, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_spans():
    rng = np.random.default_rng(3)
    for _ in range(200):
        item, part = rng.integers(0, 4, rng.integers(1, 8)), rng.integers(0, 4, rng.integers(0, 12))
        d, a, b = decontamination.edit_span(item, part)
        assert d == plain_distance(list(item), list(part)) == plain_distance(list(item), list(part[a:b]))


def test_op6(spark, sf_dir):
    items = {r["item_id"]: decontamination.words(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    texts = {d: decontamination.words(t) for d, t in sf_documents(spark, sf_dir).items()}
    want = set()
    for d, words in texts.items():
        bag = set(words)
        for i, item in items.items():
            if sum(w in bag for w in item) >= len(item) - len(item) // 5 and plain_distance(item, words) <= len(item) // 5:
                want.add((d, i, plain_distance(item, words)))
    assert want and {(r["doc_id"], r["item_id"], r["distance"]) for r in decontamination.op6_decontamination(spark, sf_dir).collect()} == want


def test_recall_at_the_full_distance():
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [(k, rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(400)], k=rng.randrange(15, 60))) for k in range(60)]
    index, texts, want = decontamination.Index(items), [], []
    for n in range(300):
        k = rng.randrange(60)
        words = list(items[k][1])
        for _ in range(len(words) // 5):
            at, kind = rng.randrange(len(words)), rng.random()
            words[at : at + (kind < 0.8)] = ["foreign"] * (not 0.6 <= kind < 0.8)
        texts.append(" ".join(rng.choices(vocabulary, k=40) + words + rng.choices(vocabulary, k=40)))
        want.append((n, k))
    found = {(d, k) for d, k, *_ in index.search(texts)}
    assert sum(w in found for w in want) >= 0.95 * len(want)


@pytest.mark.parametrize("size", [20, 100, 200, 400])
def test_all_long_copies_at_the_full_distance(size):
    rng = random.Random(size)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [(k, rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(400)], k=size)) for k in range(10)]
    index, texts = decontamination.Index(items), []
    for n in range(20):
        words = list(items[n % 10][1])
        for _ in range(size // 5):
            at, kind = rng.randrange(len(words)), rng.random()
            words[at : at + (kind < 0.8)] = ["foreign"] * (not 0.6 <= kind < 0.8)
        texts.append(" ".join(rng.choices(vocabulary, k=40) + words + rng.choices(vocabulary, k=40)))
    found = {(d, i): distance for d, i, distance, *_ in index.search(texts)}
    for n, text in enumerate(texts):
        assert found[n, n % 10] == plain_distance(items[n % 10][1], text.split())


def test_decontamination_edges(spark):
    docs = documents(spark, [*ODD, (20, "Alpha, beta gamma DELTA epsilon zeta", "en"), (21, "alpha beta gamma delta x epsilon", "en"), (22, "alpha beta", "en")])
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon"), (1, "alpha beta gamma delta epsilon"), (2, None), (3, ""), (4, "alpha beta"), (None, "x x x x x")], "item_id long, text string")
    found = sorted(decontamination.matches(docs, items).collect(), key=str)
    assert [(r["doc_id"], r["item_id"], r["distance"]) for r in found if r["item_id"] == 1] == [(20, 1, 0), (20, 1, 0), (21, 1, 1), (21, 1, 1)]
    assert {r["doc_id"] for r in found if r["item_id"] is None} == {7}
    assert decontamination.matches(docs, items.limit(0)).count() == 0 and decontamination.matches(docs.limit(0), items).count() == 0
    left = decontamination.drop_contaminated(docs, items)
    assert left.columns == docs.columns and left.count() == docs.count() - 4  # 7, 20 and 21, and 22 by the item of two words
    assert decontamination.drop_contaminated(docs, items, min_words=5).count() == docs.count() - 3
    assert len(list(decontamination.blocks(items, size=1))) == 4
    # several blocks give the same, one after the other
    assert sorted(decontamination.matches(docs, items, size=1).collect(), key=str) == found
    assert sorted(map(str, decontamination.drop_contaminated(docs, items, size=1).collect())) == sorted(map(str, left.collect()))


def plain_words(text):
    """Words by the definition: runs of word characters, but each character of an unspaced script is one."""
    out, open_ = [], False
    for c in (text or "").lower():
        single = decontamination.UNSPACED_CHARACTER.match(c) is not None
        if not (c.isalnum() or c == "_"):
            open_ = False
        elif single or not open_:
            out.append(c)
            open_ = not single
        else:
            out[-1] += c
    return out


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB1_ .\n漢字かなไทยé語", max_size=30))
def test_words_of_unspaced_scripts(text):
    assert decontamination.words(text) == [w for w in plain_words(text)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc漢字"), min_size=1, max_size=8), min_size=1, max_size=5), st.lists(st.lists(st.sampled_from("abc漢字z"), max_size=25), min_size=1, max_size=4))
def test_short_items_against_brute_force(items, texts):
    items = [(k, w) for k, w in enumerate(items)]
    found = {(d, k): distance for d, k, distance, *_ in decontamination.Index(items).search([" ".join(t) for t in texts])}
    want = {}
    for d, t in enumerate(texts):
        for k, w in items:
            distance = plain_distance(w, t)
            if distance <= len(w) // 5:
                want[d, k] = distance
    assert found == want


def test_short_and_unspaced_items(spark):
    text = "这是一个用于测试的很长的中文句子没有任何空格也没有标点符号"
    docs = spark.createDataFrame([(1, "前文" + text + "后文"), (2, "前文" + text.replace("测试", "考试") + "后文"), (3, "to be, or"), (4, "so TO BE it is"), (5, "tobe")], "doc_id long, text string")
    items = spark.createDataFrame([(1, text), (2, "To be"), (3, "be")], "item_id long, text string")
    rows = {(r["doc_id"], r["item_id"]): (r["distance"], r["start_word"]) for r in decontamination.matches(docs, items).collect()}
    assert rows == {(1, 1): (0, 2), (2, 1): (1, 2), (3, 2): (0, 0), (4, 2): (0, 1), (3, 3): (0, 1), (4, 3): (0, 2)}
