"""URL filters, classifier, license scans, tool calls, HTML, fixity and the pipeline."""

import html
import inspect
import json
import math
import random
import re
import textwrap
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from deltaweave.llm import decontamination, html_extraction, license_scan, quality_classifier, quality_rules, queries, sentencepiece_bpe, simhash, tool_calls, url_filters, warc_fixity

from ..oracle import duck, same_rows


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf_dir, name):
    assert same_rows(queries.queries()[name](spark, sf_dir), duck(sf_dir), queries.oracle_sql()[name])


NATIVE = ("op1_url_filters", "op3_license_scan", "op4_tool_calls", "op10_warc_fixity")


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans_have_no_python(spark, sf_dir, name):
    plan = queries.queries()[name](spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("module", [url_filters, license_scan, tool_calls, warc_fixity])
def test_native_modules_use_no_python_workers(module):
    """Steps that are written on the way don't show in the last plan, so the source is looked at too."""
    assert not re.search(r"pandas|pyarrow|mapIn|applyIn|\budf\b|\.rdd\b|toArrow|toPandas|parallelize", inspect.getsource(module))


# --- URL filters -----------------------------------------------------------------------------------


def listed(spark, rows):
    return url_filters.entries(spark, rows)


def test_url_intervals_and_edges(spark):
    rows = (
        ("a", "domain", "X.org", "add", "2024-01-01 00:00:00"), ("a", "domain", "x.org", "add", "2024-02-01 00:00:00"), ("a", "domain", "x.org", "remove", "2024-03-01 00:00:00"), ("a", "domain", "x.org", "add", "2024-03-01 00:00:00"),
        ("a", "domain", "x.org", "remove", "2024-04-01 00:00:00"), ("b", "host", "x.org", "remove", "2024-01-01 00:00:00"), ("b", "path", "x.org/p/q", "add", "2024-01-01 00:00:00"), ("b", "path", "x.org/p/q", "add", "2024-01-01 00:00:00"),
    )
    spans = url_filters.intervals(listed(spark, rows)).collect()
    assert sorted((r["list"], str(r["since"])[:10], str(r["until"])[:10]) for r in spans) == [("a", "2024-01-01", "2024-04-01"), ("b", "2024-01-01", "None")]
    captures = [
        (1, "http://user@sub.X.org:80/", "2024-03-01 00:00:00"), (2, "https://x.org/p/q/r?z#y", "2024-02-02 00:00:00"), (3, "https://x.org/p/qq", "2024-04-01 00:00:00"), (4, "notx.org", "2024-02-01 00:00:00"), (5, "https://notx.org/", "2024-02-01 00:00:00"),
        (6, None, "2024-02-01 00:00:00"), (7, "", "2024-02-01 00:00:00"), (8, "https://x.org/", None), (9, "https://x.org", "2023-12-31 23:59:59"), (9, "https://x.org", "2023-12-31 23:59:59"), (10, "https://x.org/" + "a/" * 3000, "2024-01-01 00:00:00"),
    ]
    df = spark.createDataFrame(captures, "id long, url string, at string").withColumn("fetched_at", F.to_timestamp("at")).withColumn("lists", F.lit("clash")).withColumn("kind", F.lit("clash"))
    want = {1: "a", 2: "a,b", 3: "", 4: "", 5: "", 6: "", 7: "", 8: "", 9: "", 10: "a"}
    for most, per_salt in ((url_filters.MAX_SENT_PATTERNS, 100), (0, 1)):  # broadcast, and shuffled with salts
        rows_ = url_filters.evaluate(df, listed(spark, rows), "id", most, per_salt).collect()
        assert len(rows_) == len(captures) and {r["id"]: r["lists"] for r in rows_} == want
    assert url_filters.evaluate(df.limit(0), listed(spark, rows)).count() == 0
    assert url_filters.evaluate(df, listed(spark, rows).limit(0)).where("blocked").isEmpty()


def test_url_patterns_as_written(spark):
    """Paths keep their case, hosts don't; slashes at the end mean nothing; rows of one id are judged apart."""
    day = "2024-01-01 00:00:00"
    rows = (("case", "path", "X.org/Docs", "add", day), ("slash", "path", "x.org/p/", "add", day), ("double", "path", "x.org//q//r//", "add", day), ("root", "path", "y.org/", "add", day), ("host", "host", "Z.Org", "add", day))
    urls = ["https://x.org/docs/a", "https://X.ORG/Docs/a", "https://x.org/Docs", "https://x.org/p", "https://x.org/p/", "https://x.org/pp", "https://x.org/q/r/s?t", "https://x.org//q///r", "https://y.org", "https://y.org/any/thing", "http://z.org./", "http://a.z.org/"]
    want = ["", "case", "case", "slash", "slash", "", "double", "double", "root", "root", "host", ""]
    df = spark.createDataFrame([(None if k % 2 else 1, u) for k, u in enumerate(urls)], "id long, url string").withColumn("fetched_at", F.to_timestamp(F.lit("2024-05-05")))
    found = url_filters.evaluate(df, listed(spark, rows), "id").collect()
    assert sorted((str(r["id"]), r["lists"]) for r in found) == sorted((str(None if k % 2 else 1), w) for k, w in enumerate(want))


def test_url_depth_is_bounded(spark):
    deep = "https://x.org/" + "seg/" * 100_000
    df = spark.createDataFrame([(1, deep), (2, "https://x.org/" + "/" * 100_000 + "seg/seg"), (3, "http://" + "a." * 50_000 + "x.org/seg/seg")], "id long, url string").withColumn("fetched_at", F.to_timestamp(F.lit("2024-05-05")))
    rows = (("a", "path", "x.org/seg/seg", "add", "2024-01-01 00:00:00"), ("b", "domain", "org", "add", "2024-01-01 00:00:00"))
    assert {r["id"]: r["lists"] for r in url_filters.evaluate(df, listed(spark, rows), "id").collect()} == {1: "a,b", 2: "a,b", 3: ""}
    assert url_filters.keys(F.col("url"), 2) is not None
    assert df.where("id = 1").select(F.size(url_filters.keys(F.col("url"), 2)).alias("n")).first()["n"] == 6


def test_as_of_pick_against_brute_force(spark):
    rng = random.Random(9)
    names = [("host", "a.x.org"), ("domain", "x.org"), ("path", "a.x.org/P"), ("path", "a.x.org/p")]
    rows = tuple((f"l{rng.randrange(2)}", *rng.choice(names), rng.choice(("add", "remove")), f"2024-01-01 {rng.randrange(24):02}:{rng.randrange(3):02}:00") for _ in range(150))
    captures = [(k, f"https://{rng.choice(('a.x.org', 'b.x.org', 'x.org', 'xx.org'))}/{rng.choice(('p', 'P/q', ''))}", f"2024-01-01 {rng.randrange(24):02}:{rng.randrange(3):02}:{rng.choice((0, 30)):02}") for k in range(200)]

    def lists(url, at):
        host, _, path = url.removeprefix("https://").partition("/")
        on = {}
        for name, kind, pattern, action, t in sorted(rows, key=lambda r: (r[4], r[3] == "add")):
            if t <= at:
                on[name, kind, pattern] = action == "add"
        hit = {"host": lambda p: p == host, "domain": lambda p: (f".{host}").endswith(f".{p}"), "path": lambda p: f"{host}/{path}/".startswith(f"{p}/")}
        return ",".join(sorted({n for (n, kind, p), v in on.items() if v and hit[kind](p)}))

    df = spark.createDataFrame(captures, "id long, url string, at string").withColumn("fetched_at", F.to_timestamp("at"))
    want = {k: lists(url, at) for k, url, at in captures}
    assert len(set(want.values())) == 4
    for per_salt in (url_filters.ROWS_PER_SALT, 3):
        assert {r["id"]: r["lists"] for r in url_filters.evaluate(df, listed(spark, rows), "id", per_salt=per_salt).collect()} == want


def test_url_query_lists_something(spark, sf_dir):
    found = url_filters.op1_url_filters(spark, "/root/testdata/sf0.01").groupBy("lists").count().collect()
    assert {"", "review", "spam", "optout"} <= {r["lists"] for r in found}


# --- quality classifier ----------------------------------------------------------------------------


def plain_model(texts):
    """Interpolated modified Kneser-Ney probabilities of single n-grams, by dictionaries."""
    order = quality_classifier.ORDER
    counts = {order: {}}
    for t in texts:
        s = [2] * (order - 1) + quality_classifier.classes(t).tolist() + [3]
        for i in range(len(s) - order + 1):
            g = tuple(s[i : i + order])
            counts[order][g] = counts[order].get(g, 0) + 1
    for k in range(order - 1, 0, -1):
        counts[k] = {}
        for g in counts[k + 1]:
            counts[k][g[1:]] = counts[k].get(g[1:], 0) + 1
    discount = {k: quality_classifier._discounts([sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]) for k, c in counts.items()}
    contexts = {}
    for k, c in counts.items():
        for g, n in c.items():
            total, freed = contexts.get((k, g[:-1]), (0, 0.0))
            contexts[k, g[:-1]] = total + n, freed + discount[k][min(n, 3) - 1]

    def p(g):
        k = len(g)
        low = 1 / quality_classifier.CLASSES if k == 1 else p(g[1:])
        if (k, g[:-1]) not in contexts:
            return low
        total, freed = contexts[k, g[:-1]]
        n = counts[k].get(g, 0)
        return (n - discount[k][min(n, 3) - 1] if n else 0) / total + freed / total * low

    return p


def folds_of(docs):
    return {r["doc_id"]: r["f"] for r in docs.select("doc_id", quality_classifier.fold_of(F.col("doc_id")).alias("f")).collect()}


def test_classifier_against_brute_force(spark):
    rows = [(k, "en" if k % 3 else None, f"the cat {k % 7} sat on the mat {'again ' * (k % 4)}{k}") for k in range(120)] + [(500, "en", "zzqx ### ***"), (501, "xx", "other"), (502, "en", None), (503, "en", "漢字 the cat"), (504, "en", ""), (504, "en", "")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("perplexity", F.lit(1)).withColumn("n", F.lit("x"))
    labels = spark.createDataFrame([(k, 1, 0) for k in range(120)] + [(500, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    fitted = quality_classifier.Classifier(docs, labels)
    fold = folds_of(docs)
    assert set(fold.values()) == {0, 1}
    # a document is scored by what the trusted documents of the other fold say
    p = [plain_model([t for k, lang, t in rows if k < 120 and lang == "en" and fold[k] != f]) for f in (0, 1)]

    def perplexity(k, text):
        s = [2] * 4 + quality_classifier.classes(text).tolist() + [3]
        logs = [math.log(p[fold[k]](tuple(s[i : i + 5]))) for i in range(len(s) - 4)]
        return math.exp(-sum(logs) / len(logs))

    found = fitted.verdicts(docs).collect()
    assert len(found) == len(rows)
    texts = {k: t for k, _, t in rows}
    for r in found:
        if r["lang"] == "en":
            assert r["perplexity"] == pytest.approx(perplexity(r["doc_id"], texts[r["doc_id"]]), rel=1e-4)
    kept = {r["doc_id"]: r["kept"] for r in found}
    assert not kept[500] and kept[501] and sum(not kept[k] for k in range(120)) <= 2
    assert fitted.keep(docs).columns == docs.columns and {r["doc_id"] for r in fitted.keep(docs).collect()} == {k for k, v in kept.items() if v}
    # beyond the bounds the shuffled joins give the same; several shards too
    for other in (quality_classifier.Classifier(docs, labels, max_bytes=0), quality_classifier.Classifier(docs, labels, shard_rows=300)):
        again = sorted((str(r["doc_id"]), round(r["perplexity"] or 0, 4), r["kept"]) for r in other.verdicts(docs).collect())
        assert again == sorted((str(r["doc_id"]), round(r["perplexity"] or 0, 4), r["kept"]) for r in found)
    assert fitted.verdicts(docs.limit(0)).count() == 0
    assert quality_classifier.Classifier(docs, labels.limit(0)).verdicts(docs).where("not kept").isEmpty()


def test_more_folds(spark, monkeypatch):
    monkeypatch.setattr(quality_classifier, "FOLDS", 3)
    rows = [(k, "en", f"the cat {k % 7} sat on the mat {k}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    fold = folds_of(docs)
    p = {f: plain_model([t for k, _, t in rows if fold[k] != f]) for f in range(3)}
    for r in quality_classifier.Classifier(docs, labels).verdicts(docs).collect():
        s = [2] * 4 + quality_classifier.classes(rows[r["doc_id"]][2]).tolist() + [3]
        logs = [math.log(p[fold[r["doc_id"]]](tuple(s[i : i + 5]))) for i in range(len(s) - 4)]
        assert r["perplexity"] == pytest.approx(math.exp(-sum(logs) / len(logs)), rel=1e-4)


def test_keep_by_join_drops_rows_not_ids(spark):
    good = [(k, "en", f"the cat {k % 7} sat on the mat {'again ' * (k % 4)}{k}") for k in range(120)]
    docs = spark.createDataFrame([*good, (None, "en", "zzqx ### ***"), (None, "en", good[0][2]), (5, "en", "zzqx ### ***")], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(120) if k != 5], "doc_id long, quality int, toxic int")
    first, second = (quality_classifier.Classifier(docs, labels, max_bytes=n).keep(docs) for n in (quality_classifier.MAX_MODEL_BYTES, 0))
    want = sorted(map(str, first.collect()))
    assert second.columns == docs.columns and sorted(map(str, second.collect())) == want
    assert not first.where("text = 'zzqx ### ***'").count() and first.where("doc_id is null").count() == 1 and first.where("doc_id = 5").count() == 1


def test_classifier_starts_no_other_python_workers(spark, monkeypatch):
    from pyspark.core.rdd import RDD

    monkeypatch.setattr(RDD, "map", lambda *a, **k: pytest.fail("rows of Python objects"))
    made = quality_classifier._table(spark, [("0:en", 0.5, 1.0, 1.5)], ["lang", "d1", "d2", "d3"])
    assert [tuple(r) for r in made.collect()] == [("0:en", 0.5, 1.0, 1.5)]
    none = quality_classifier._table(spark, [], ["_l", "_m", "_limit"])
    assert none.dtypes == [("_l", "string"), ("_m", "double"), ("_limit", "double")] and none.isEmpty()


def test_classifier_limit_is_a_quantile_of_trusted_texts(spark):
    rows = [(k, "en", " ".join(f"word{(k * 7919 + j * j * (1 + k % 13)) % 97}" for j in range(5 + k % 40))) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(600)], "doc_id long, quality int, toxic int")
    fitted = quality_classifier.Classifier(docs, labels)
    m, limit = fitted.limits["en"]
    excess = sorted((math.log(r["perplexity"]) - m) * math.sqrt(r["n"] / (r["n"] + quality_classifier.PRIOR)) for r in fitted.scored(docs).collect())
    over = sum(e > limit + 1e-9 for e in excess)
    assert len(excess) == 600 and 1 <= over <= math.ceil((1 - quality_classifier.QUANTILE) * len(excess))
    assert sum(not r["kept"] for r in fitted.verdicts(docs).collect()) == over


def test_small_languages_have_limits(spark):
    """With few trusted texts a language takes its own greatest excess or that of all, whichever is more."""
    held = spark.createDataFrame([("a", k / 100, 1000) for k in range(1000)] + [("b", 1.0, 1000), ("b", 1.5, 1000)], "lang string, x double, n long")
    found = quality_classifier.limits(held)
    half = math.sqrt(0.5)
    assert found["a"][1] == pytest.approx((9.89 - 4.99) * half, abs=0.05) and found["b"][1] == pytest.approx(found["a"][1], abs=0.05)
    only = quality_classifier.limits(held.where("lang = 'b'"))
    assert only["b"] == (1.0, pytest.approx(0.5 * half))
    assert quality_classifier.limits(held.limit(0)) == {}


def test_limits_do_not_depend_on_how_rows_are_dealt(spark):
    rng = np.random.default_rng(7)
    rows = [(str(k % 2), float(x), int(n)) for k, (x, n) in enumerate(zip(rng.normal(2, 1, 40_000), rng.integers(1, 5000, 40_000)))]
    held = spark.createDataFrame(rows, "lang string, x double, n long")
    found = quality_classifier.limits(held.repartition(7))
    assert found == quality_classifier.limits(held.orderBy("x").coalesce(2))
    step = quality_classifier.GRID
    for lang in "01":
        x, n = np.array([r[1:] for r in rows if r[0] == lang]).T
        m = np.sort(x)[len(x) // 2 - 1]
        e = np.sort((x - found[lang][0]) * np.sqrt(n / (n + quality_classifier.PRIOR)))
        assert 0 <= found[lang][0] - m <= 1.001 * step
        assert 0 <= found[lang][1] - e[int(np.ceil(len(e) * quality_classifier.QUANTILE)) - 1] <= 1.001 * step


def test_classifier_rejects_bad_texts_of_all_languages(spark):
    sf = "/root/testdata/sf0.01"
    found = quality_classifier.op2_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").cache()
    assert found.where("quality = 1 and not kept").count() <= 0.01 * found.where("quality = 1").count() + 1
    shares = {r["lang"]: r["share"] for r in found.where("quality = 0").groupBy("lang").agg(F.avg((~F.col("kept")).cast("double")).alias("share")).collect()}
    assert shares.keys() == {"de", "en", "es", "fr"} and all(x >= 0.6 for x in shares.values())


# --- license scans ----------------------------------------------------------------------------------


def test_licenses(spark):
    rows = [
        (1, "a/LICENSE", "MIT, see\nReleased under the MIT License."), (2, "a/b/x.txt", "nothing"), (3, "a/b/c/d.txt", None), (4, "ab/x.txt", "plain"), (5, "a/b/c/COPYING.md", "licensed under the apache license, version 2.0"),
        (6, "a/y", "x\nThis work is licensed under the GNU General Public License, version 3.\nReleased under the MIT License."), (7, None, "copyright"), (8, "", ""), (9, "a/b/c/d/e.txt", "a license is " + "long " * 5000), (9, "a/b/c/d/e.txt", "again"), (10, "a/b/c/LICENSE", "Released under the MIT License"),
    ]
    df = spark.createDataFrame(rows, "id long, path string, text string").withColumns({n: F.lit("clash") for n in ("dir", "own", "score", "line", "license")})
    found = {r["id"]: (r["license"], r["basis"], r["source_dir"]) for r in license_scan.scan(df).collect()}
    assert found == {
        1: ("MIT", "own", None), 2: ("MIT", "inherited", "a"), 3: (found[3][0], "inherited", "a/b/c"), 4: (None, "none", None), 5: ("Apache-2.0", "own", None), 6: ("GPL-3.0", "own", None), 7: (None, "none", None), 8: (None, "none", None),
        9: (found[3][0], "inherited", "a/b/c"), 10: ("MIT", "own", None),
    }
    assert license_scan.scan(df).count() == len(rows) and license_scan.scan(df.limit(0)).count() == 0


def comment(text, mark=" * "):
    return "/*\n" + "\n".join(mark + x for x in text.split("\n")) + "\n */\nint main(void) { return 0; }\n"


def wrapped(text, width=72):
    return "\n".join(textwrap.wrap(text, width))


APACHE_HEAD = """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions.

      "License" shall mean the terms and conditions for use, reproduction,
      and distribution as defined by Sections 1 through 9 of this document.
"""
GPL_HEAD = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble

  The GNU General Public License is a free, copyleft license for
software and other kinds of works.
"""
GPL_HEADER = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""


def paragraphs(name, *texts):
    return f"{name}\n\nCopyright (c) 2019, Ada Example and others\nAll rights reserved.\n\n" + "\n\n".join(wrapped(t) for t in texts)


def test_license_texts(spark):
    t = license_scan
    bsd = (t.REDISTRIBUTION.split(" 1. ")[0], "1. " + t.REDISTRIBUTION.split(" 1. ")[1].split(" 2. ")[0], "2. " + t.REDISTRIBUTION.split(" 2. ")[1])
    files = {
        "mit/LICENSE": ("MIT", paragraphs("MIT License", t.PERMISSION, t.NOTICE, t.AS_IS)), "a/x.c": ("Apache-2.0", comment(wrapped(t.TEXTS[0][1]))), "apache/LICENSE": ("Apache-2.0", APACHE_HEAD), "g/x.c": ("GPL-3.0", comment(GPL_HEADER)),
        "g/COPYING": ("GPL-3.0", GPL_HEAD), "b3/LICENSE.txt": ("BSD-3-Clause", paragraphs("BSD 3-Clause License", *bsd, t.ENDORSE, t.DISCLAIMER)), "b2/LICENSE": ("BSD-2-Clause", paragraphs("BSD 2-Clause License", *bsd, t.DISCLAIMER)),
        "b3/x.c": ("BSD-3-Clause", "int x;"), "s/x.py": ("GPL-2.0", "# SPDX-License-Identifier: GPL-2.0-only\nx = 1"), "s/y.py": ("LGPL-2.1", "# SPDX-License-Identifier: LGPL-2.1-or-later"), "m/x.js": ("MPL-2.0", comment(wrapped(t.TEXTS[8][1]))),
        "mit2/x.py": ("MIT", "# " + wrapped(t.PERMISSION).replace("\n", "\n# ") + "\n#\n# " + wrapped(t.NOTICE).replace("\n", "\n# ")), "r/x": ("Proprietary", "Copyright 2020 X.\nAll rights reserved."), "r/y": ("MIT", "All rights reserved.\n\nReleased under the MIT License."),
        "n/prose": (None, "It is a long story of the people and the license that they had to keep, and of the permission\nthat nobody gave them, so they went away and came back in spring."),
    }
    df = spark.createDataFrame([(k, p, text) for k, (p, (_, text)) in enumerate(files.items())], "id long, path string, text string")
    assert {r["path"]: r["license"] for r in license_scan.scan(df).collect()} == {p: want for p, (want, _) in files.items()}


# --- tool calls ---------------------------------------------------------------------------------------


def test_tool_calls(spark):
    calls = [
        (1, "a", 0, "search", '{"top": 1.0e0, "query":"x"}', ["b"]), (1, "b", 1, "search", '{"query": "y", "top": 3}', ["c", "missing"]), (1, "c", 2, "search", '{"query": 5}', []), (1, "c", 3, "search", '{"query": "late"}', None), (1, "d", 4, "other", "{}", ["e"]),
        (1, "e", 5, "search", "[1]", ["d"]), (1, "f", 6, "search", None, ["e"]), (None, "g", 0, "search", "{}", []), (2, None, 0, "search", "{}", []), (2, "a", 0, "search", '{"query":"a","query":"b"}', ["a"]), (3, "a", None, None, '{"b":{"d":1,"c":[2,1]},"a":"é\\n"}', []),
    ]
    results = [(1, "a", 1, "second"), (1, "a", 0, "first"), (1, "zz", 9, "lost"), (1, "c", 9, None), (None, "c", 1, "x"), (3, None, 1, "y")]
    c = spark.createDataFrame(calls, "conv_id long, call_id string, seq long, name string, arguments string, after array<string>").withColumn("level", F.lit("clash")).withColumn("params", F.lit(1))
    r = spark.createDataFrame(results, "conv_id long, call_id string, seq long, content string").withColumn("result", F.lit(1))
    rows = tool_calls.link(c, r, tool_calls.schemas(spark)).collect()
    got = {(x["conv_id"], x["call_id"]): x for x in rows}
    assert {k: (x["status"], x["level"], x["position"], x["errors"]) for k, x in got.items()} == {
        (1, "c"): ("ok", 0, 0, "type:query"), (1, "b"): ("missing_result", 1, 1, ""), (1, "a"): ("ok", 2, 2, "type:top"), (1, "d"): ("missing_result", None, 3, "unknown_tool"), (1, "e"): ("missing_result", None, 4, "not_json"), (1, "f"): ("missing_result", None, 5, "not_json"),
        (1, "zz"): ("orphan_result", None, None, None), (None, "g"): ("no_id", None, None, "missing:query"), (2, None): ("no_id", None, None, "missing:query"), (None, "c"): ("no_id", None, None, None), (3, None): ("no_id", None, None, None), (2, "a"): ("missing_result", None, 0, "not_json"), (3, "a"): ("missing_result", 0, 0, "unknown_tool"),
    }
    assert got[3, "a"]["canonical"] == '{"arguments":{"a":"é\\n","b":{"c":[2,1],"d":1}},"id":"a"}'
    assert json.loads(got[1, "a"]["canonical"])["result"] == "first"
    assert got[None, "c"]["canonical"] == '{"id":"c","result":"x"}' and got[3, None]["canonical"] == '{"result":"y"}' and got[None, "g"]["canonical"] == '{"arguments":{},"id":"g","name":"search"}'
    assert tool_calls.link(c.limit(0), r.limit(0), tool_calls.schemas(spark)).count() == 0


def plain_levels(after):
    """Longest chains by removing calls that wait for nothing; None on and behind cycles."""
    open_ = {c: {n for n in needs if n in after} for c, needs in after.items()}
    out = {}
    while ready := [c for c, needs in open_.items() if c not in out and all(n in out for n in needs)]:
        out |= {c: max((out[n] + 1 for n in open_[c]), default=0) for c in ready}
    return {c: out.get(c) for c in after}


@pytest.mark.parametrize("seed", range(3))
def test_levels_against_brute_force(spark, seed):
    rng, rows, want = random.Random(seed), [], {}
    for conv in range(25):
        n = rng.randrange(1, 14)
        after = {f"c{k}": list({f"c{rng.randrange(n + 1) if rng.random() < 0.08 else rng.randrange(k)}" for _ in range(rng.choice((0, 1, 1, 1, 2, 3)))}) if k else [] for k in range(n)}
        rows += [(conv, c, needs) for c, needs in after.items()]
        want |= {(conv, c): v for c, v in plain_levels(after).items()}
    df = spark.createDataFrame(rows, "conv_id long, call_id string, after array<string>")
    assert {(r["conv_id"], r["call_id"]): r["level"] for r in tool_calls.levels(df).collect()} == want
    assert None in want.values()


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, made = 3000, []
    write = tool_calls.materialize
    monkeypatch.setattr(tool_calls, "materialize", lambda df, name: made.append(name) or write(df, name))
    df = spark.range(n).selectExpr("1L as conv_id", "concat('c', id) as call_id", "case when id = 0 then array('none') when id = 2000 then array('c1999', 'c7') else array(concat('c', id - 1)) end as after")
    df = df.unionByName(spark.createDataFrame([(1, "x", ["y"]), (1, "y", ["x"]), (1, "z", ["y", "c5"])], "conv_id long, call_id string, after array<string>"))
    found = {r["call_id"]: r["level"] for r in tool_calls.levels(df).collect()}
    assert found == {f"c{k}": k for k in range(n)} | {"x": None, "y": None, "z": None}
    assert len(made) < 40


def test_nested_and_enumerated_arguments(spark):
    tools = tool_calls.schemas(spark, (("f", "lang", "string", True, ("de", "en")), ("f", "opts", "object", False), ("f", "opts.top", "integer", True, (1, 5)), ("f", "opts.on", "boolean", False)))
    cases = {
        '{"lang":"de"}': "", '{"lang":"fr"}': "value:lang", '{"lang":1}': "type:lang", '{"lang":"en","opts":{"top":5,"on":true}}': "", '{"lang":"en","opts":{"on":true}}': "missing:opts.top",
        '{"lang":"en","opts":{"top":7,"on":1,"x":0}}': "type:opts.on,unexpected:opts.x,value:opts.top", '{"lang":"en","opts":[1]}': "missing:opts.top,type:opts", '{"lang":"en","opts":{"top":"5"},"y":{"z":1}}': "type:opts.top,unexpected:y",
    }
    calls = spark.createDataFrame([(1, f"c{k}", k, "f", a, []) for k, a in enumerate(cases)], "conv_id long, call_id string, seq long, name string, arguments string, after array<string>")
    results = spark.createDataFrame([], "conv_id long, call_id string, seq long, content string")
    found = {r["call_id"]: r["errors"] for r in tool_calls.link(calls, results, tools).collect()}
    assert found == {f"c{k}": e for k, e in enumerate(cases.values())}


def test_positions_over_ranges(spark):
    rows = [(k % 2, f"c{k}", (k * 37) % 1000, k % 3) for k in range(1500)]
    df = spark.createDataFrame(rows, "conv_id long, call_id string, seq long, level int")
    found = {(r["conv_id"], r["call_id"]): r["position"] for r in tool_calls.positions(df).collect()}
    for conv in (0, 1):
        mine = sorted((lv, seq, c) for v, c, seq, lv in rows if v == conv)
        assert all(found[conv, c] == k for k, (_, _, c) in enumerate(mine))


# --- HTML ---------------------------------------------------------------------------------------------


def test_op7(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = html_extraction.op7_html_extraction(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search("<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("</?b>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", inner))
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


DIVS = """<html><body><header><h1>Site</h1><nav><a href=x>Home</a></nav></header><div id="cookie-notice">We use cookies</div><div class="wrap"><div class="sidebar"><p>Popular posts, many of them, enjoy reading all of them today, really.</p></div>
<div class="post-content c%d"><h2>Title</h2><p>First   paragraph with, some commas and a long enough text to count.<p>Second&nbsp;one &lt;b&gt; <a href=z>link</a> &amp; more.<ul><li>item one<li>item two</ul><script>var x = "</p>";</script><form><p>Subscribe to our letter, it is great, really great it is</p></form></div>
<div class="comments"><div class="comment"><p>I totally disagree, this is a reader comment that is quite long, yes, quite long indeed.</p></div></div></div><footer>c</footer></body></html>"""
TEXT = "Title\nFirst paragraph with, some commas and a long enough text to count.\nSecond one <b> link & more.\nitem one\nitem two"


def test_html_edges(spark):
    rows = [(1, "http://h.org/1", DIVS % 1), (2, "http://H.org/2", DIVS % 22), (3, None, "<p>just text"), (4, "nonsense", None), (5, "http://e.org/", ""), (6, "http://h.org/6", "<div class='plain'>alone</div><!-- open"), (6, "http://h.org/6", "plain & simple <"), (7, "http://l.org", "<p>" + "word, " * 40000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({n: F.lit("clash") for n in ("host", "path", "votes", "text")})
    found = sorted((r["page_id"], r["text"][:200]) for r in html_extraction.extract_pages(df).collect())
    assert found == [(1, TEXT), (2, TEXT), (3, "just text"), (4, ""), (5, ""), (6, "alone"), (6, "plain & simple <"), (7, ("word, " * 40)[:200])]
    assert html_extraction.extract_pages(df.limit(0)).count() == 0
    best = {r["host"]: r["path"] for r in html_extraction.winners(html_extraction.hosts(df)).collect()}
    assert best["h.org"].endswith("/div.c#.post-content")


def test_consensus_overrides_a_page(spark):
    odd = "<html><body><div class='box'><p>%s</p></div><div class='post-content'><p>short, but the article it is</p></div></body></html>" % ("An unusual long notice, that only one page has, " * 5)
    usual = "<html><body><div class='box'><p>tiny</p></div><div class='post-content'><p>%s</p></div></body></html>" % ("Here is the article, with commas, and length. " * 8)
    df = spark.createDataFrame([(k, "http://h.org/", odd if k == 0 else usual) for k in range(9)], "page_id long, url string, html string")
    assert html_extraction.extract(odd, None).startswith("An unusual")
    assert {r["page_id"]: r["text"] for r in html_extraction.extract_pages(df).collect()}[0] == "short, but the article it is"


LONG = "Here is the article, with commas, and length. " * 4


@pytest.mark.parametrize("wrapper", ["body class='no-sidebar'", "div class='content with-sidebar'", "div class='comments-open'", "div style='overflow:hidden'", "div data-hidden='false'", "div title='a class=ad b'", "main class='has-sidebar'", "div class='social-page'"])
def test_wrappers_are_not_dropped_by_loose_names(wrapper):
    page = f"<html><{wrapper}><article><h1>Title</h1><p>{LONG}</p></article><div class='sidebar'><p>{LONG * 3}</p></div></{wrapper.split()[0]}></html>"
    assert html_extraction.extract(page, None) == "Title\n" + LONG.strip()


def test_hidden_and_named_parts_stay_dropped():
    for part in ("div hidden", "div hidden=''", "div aria-hidden='true'", "div class='left-sidebar'", "div class='comments'", "div id=cookie-notice"):
        page = f"<body><div class='content'><p>{LONG}</p></div><{part}><p>{LONG * 3}</p></div></body>"
        assert html_extraction.extract(page, None) == LONG.strip()


@pytest.mark.parametrize(
    "inner, want",
    [
        ("<article><h1>T</h1><p>A lead.</p><div class=content><p>{a}</p></div></article>", "T|A lead.|{a}"), ("<article><section><p>{a}</p></section><section><h2>S</h2><p>short</p></section></article>", "{a}|S|short"),
        ("<main><h1>T</h1><section><p>{a}</p></section><section><p>short</p></section></main>", "T|{a}|short"), ("<div id=w><h1>T</h1><p>A lead.</p><div class=content><p>{a}</p></div><div class=content><p>short</p></div></div>", "T|A lead.|{a}|short"),
        ("<section><p>{a}</p></section><section><p>short</p></section>", "{a}|short"), ("<main><article><p>{a}</p></article><article><p>other</p></article></main>", "{a}"), ("<div><p>menu</p></div><div><p>{a}</p></div>", "{a}"),
    ],
)
def test_the_whole_article(spark, inner, want):
    page = "<html><body><header><h1>Site</h1></header>" + inner.format(a=LONG) + "<footer>f</footer></body></html>"
    want = want.format(a=LONG.strip()).replace("|", "\n")
    assert html_extraction.extract(page, None) == want
    df = spark.createDataFrame([(k, "http://h.org/", page) for k in range(3)], "page_id long, url string, html string")
    assert {r["text"] for r in html_extraction.extract_pages(df).collect()} == {want}


SHAPES = {
    "classed body": ("<body class='has-sidebar modal-open'><div><p>{a}</p></div></body>", "{a}"),
    "wrapping form": ("<body><form action=x><h1>T</h1><div class=content><p>{a}</p></div><label>q</label><input><select><option>o</select></form></body>", "T|{a}"),
    "form without an article around": ("<body><form><p>{a}</p></form></body>", "{a}"),
    "small form": ("<body><div class=post><p>{a}</p><form><p>Subscribe, please, to our letter</p></form></div></body>", "{a}"),
    "unequal sections": ("<main><section><p>{a}</p><p>{a}</p></section><section><h2>S</h2><p>short</p></section></main>", "{a}|{a}|S|short"),
    "note in a paragraph": ("<article><p>{a}</p><p class='side-note'>A note.</p><p class='advert'>Buy!</p></article>", "{a}|A note."),
    "comments inside": ("<article><h1>T</h1><p>{a}</p><div class='comments'><article class='comment-body'><p>{a}{a}</p></article></div></article>", "T|{a}"),
    "long comments": ("<div class=post><p>{a}</p></div><div id=comments><div class=comment><p>{a}{a}{a}</p></div></div>", "{a}"),
    "title beside": ("<body><h1>T</h1><div class=content><p>{a}</p></div></body>", "T|{a}"),
    "title in a box": ("<body><header><h1>Site</h1></header><div class=t><h1>T</h1></div><div class=content><p>{a}</p></div></body>", "T|{a}"),
    "site's title": ("<body><h1>Site</h1><article><h1>T</h1><p>{a}</p></article></body>", "T|{a}"),
    "title among other text": ("<body><div><h1>Site</h1><p>motto</p></div><div class=content><p>{a}</p></div></body>", "{a}"),
    "wrapper named menu": ("<div class='menu-page'><main><p>{a}</p></main></div>", "{a}"),
    "advert in a line": ("<article><p>{a}<span class=ad>Buy!</span></p></article>", "{a}"),
    "menu in an article": ("<article><nav>x</nav><p>{a}</p><ul class='share-links'><li>f</ul><aside>y</aside></article>", "{a}"),
    "deep": ("<div>" * 3000 + "<article><p>{a}</p></article>" + "</div>" * 3000, "{a}"),
    "deep sidebars": ("<div class=sidebar>" * 3000 + "<article><p>{a}</p></article>", "{a}"),
    "slash in a class": ("<div class='w-1/2 post'><p>{a}</p></div><div class='w-1/3'><p>other</p></div>", "{a}"),
}


@pytest.mark.parametrize("name", SHAPES)
def test_page_shapes(name):
    page, want = (x.replace("{a}", LONG.strip()) for x in SHAPES[name])
    assert html_extraction.extract(page, None) == want.replace("|", "\n")
    best = html_extraction.score(*html_extraction.read(page))[0]
    assert html_extraction.path_key(best.path) == best.key and html_extraction.extract(page, best.path) == want.replace("|", "\n")


@pytest.mark.parametrize("page", ["<b><p>x" * 140_000, "<b>x" * 250_000, "<div>x" * 170_000, "<div class=sidebar>" * 50_000 + "<article>x", "<i>" * 150_000 + "</u></b>" * 70_000, "<ul><li>" * 120_000, "<table><tr><td>" * 65_000, "<a href=\"x'>" * 90_000])
def test_a_megabyte_of_unclosed_tags(page):
    began = time.process_time()
    html_extraction.extract(page, None)
    assert time.process_time() - began < 15  # about 2 s; a scan of the stack for each tag takes minutes


# --- fixity ---------------------------------------------------------------------------------------------


def test_fixity_edges(spark):
    a = spark.createDataFrame([(k, f"p{k}") for k in range(3000)] + [(None, "n"), (7, "p7"), (5000, None), (5001, "")], "offset long, payload string").withColumn("digest", F.lit("clash")).withColumn("node", F.lit(1))
    assert warc_fixity.compare(a, a.orderBy(F.rand(3))).count() == 0
    b = a.where("offset is null or offset not in (0, 2999)").withColumn("payload", F.when(F.col("offset") == 64, "bad").when(F.col("offset") == 5000, "").when(F.col("offset").isNull(), "m").otherwise(F.col("payload")))
    b = b.unionByName(spark.createDataFrame([(9000, "new", "c", 1), (12, "p12", "c", 1)], "offset long, payload string, digest string, node int"))
    want = [(-1, "changed"), (0, "missing"), (12, "changed"), (64, "changed"), (2999, "missing"), (5000, "changed"), (9000, "extra")]
    assert sorted(map(tuple, warc_fixity.compare(a, b).collect())) == want
    assert sorted(map(tuple, warc_fixity.compare(a, b, span=3, fanout=2).collect())) == want
    assert warc_fixity.compare(a.limit(0), a.limit(0)).count() == 0 and warc_fixity.compare(a, a.limit(0)).count() == a.select("offset").distinct().count()


def test_fixity_of_several_columns_under_one_root(spark):
    rows = [(k if k % 5 else None, f"u{k}", f"p{k}") for k in range(200)] + [(-7, "neg", "x")]
    a = spark.createDataFrame(rows, "offset long, url string, payload string")
    tree = warc_fixity.Tree(a, warc_fixity.height([a], 4, 3), 4, 3, payload=("url", "payload"))
    assert tree.root.count() == 1
    b = a.withColumn("url", F.when(F.col("offset") == 7, "moved").otherwise(F.col("url")))
    assert [tuple(r) for r in warc_fixity.compare(a, b, payload=("url", "payload")).collect()] == [(7, "changed")]
    assert warc_fixity.compare(a, b).count() == 0
    # what stands at the border of two columns counts
    c = spark.createDataFrame([(1, "ab", "c")], "offset long, url string, payload string")
    d = spark.createDataFrame([(1, "a", "bc")], "offset long, url string, payload string")
    assert warc_fixity.compare(c, d, payload=("url", "payload")).count() == 1
    lost = a.where("url <> 'u0'")
    assert [tuple(r) for r in warc_fixity.compare(a, lost, payload=("url", "payload")).collect()] == [(-1, "changed")]


def test_every_digit_of_a_digest_counts(spark):
    """The digest of an offset changes with any part of its record's hash."""
    one = spark.createDataFrame([(1, "x")], "offset long, payload string")
    assert warc_fixity.PIECES * warc_fixity.DIGITS == 64
    assert warc_fixity.record_digests(one).first()["digest"] != warc_fixity.record_digests(one.unionByName(one)).first()["digest"]


# --- pipeline -----------------------------------------------------------------------------------------


def test_pipeline(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, stage_docs = docs.columns, docs
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "near_dedup", "decontamination", "sentencepiece"]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    left = set(texts)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage_docs = stage(spark, stage_docs, sf).cache()
        assert stage_docs.columns == columns
        now = {r["doc_id"] for r in stage_docs.collect()}
        if name == "quality_classifier":
            assert now < left
        elif name == "quality_rules":
            assert now == {d for d in left if quality_rules.cascade(quality_rules.Text(texts[d]), list(quality_rules.RULES)) is None}
        elif name == "near_dedup":
            prints = [(d, simhash.fingerprint(texts[d])) for d in sorted(left)]
            firsts = {d for k, (d, f) in enumerate(prints) if not any((f ^ g).bit_count() <= 2 for _, g in prints[:k])}
            assert now <= firsts and all(any((simhash.fingerprint(texts[d]) ^ f).bit_count() <= 2 for _, f in prints if _ != d) for d in firsts - now)
        else:
            items = [decontamination.words(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            holds = {d for d in left if any(" ".join(i) in " ".join(decontamination.words(texts[d])) for i in items)}
            assert not now & holds and len(now) >= len(left) - len(holds) - 2
        left = now
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in rows} == left
    assert all(r["n_tokens"] == len(sentencepiece_bpe.encoder().sp.encode(texts[r["doc_id"]])) + 2 for r in rows)
