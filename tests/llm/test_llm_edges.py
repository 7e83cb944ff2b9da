"""Clashing names, clashing duplicates, extreme vectors, independent fingerprints, and the pipeline on odd tables."""

import re

import numpy as np
import pytest
import xxhash
from compare import connect
from conftest import SF
from pyspark.sql import functions as F

import corpus_pipeline
from wardline.llm import ann, decontaminate, line_dedup, simhash_near, toxicity, warc_revisit
from wardline.llm.common import free_name, set_apart
from wardline.llm.queries import queries

HELPERS = {"__doc": 1, "__hash": 2, "__text": "t", "__gone": 3, "n_removed": 5, "N_LINES": 6, "own___doc": 7, "seq": 8, "__judged": 9, "judged": 10, "key": 11, "node": 12}


def words(n, seed):
    """Words of letters only: digits would be placeholders of the benchmark templates."""
    return ["".join(chr(97 + int(c)) for c in str(x)) for x in np.random.default_rng(seed).integers(10**7, 10**8, n)]


def with_helpers(frame):
    return frame.withColumns({n: F.lit(v) for n, v in HELPERS.items()})


def kept_helpers(before, after):
    assert set(before.columns) <= set(after.columns)
    assert {tuple(r) for r in after.select(*(f"`{c}`" for c in HELPERS)).collect()} == {tuple(HELPERS.values())}


def test_names():
    class Frame:
        columns = ["a", "N", "n_"]

    assert free_name(Frame, "b") == "b" and free_name(Frame, "n") == "n__"


def test_columns_with_the_names_of_helpers(spark):
    base = words(80, 1)
    rows = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join(base[:60] + words(3, 2) + base[63:])), (4, None), (5, " ".join(words(70, 3)))]
    frame = with_helpers(spark.createDataFrame(rows, "doc_id long, text string"))
    lines = line_dedup.dedupe(frame, min_words=50)
    assert lines.columns == [*frame.columns, "n_lines_", "n_removed_"] and line_dedup.count_names(frame) == ("n_lines_", "n_removed_")
    kept_helpers(frame, lines)
    assert {r.doc_id: r.n_removed_ for r in lines.collect()} == {1: 0, 2: 1, 3: 0, 4: 0, 5: 0}
    near = simhash_near.dedupe(frame)
    kept_helpers(frame, near)
    assert near.columns == frame.columns and {r.doc_id for r in near.collect()} == {1, 4, 5}
    items = spark.createDataFrame([(1, " ".join(base))], "item_id long, text string")
    clean = decontaminate.clean(frame, items)
    kept_helpers(frame, clean)
    assert clean.columns == frame.columns and {r.doc_id for r in clean.collect()} == {4, 5}
    moved, back = set_apart(frame, ["__DOC", "seq"])
    assert moved.withColumnsRenamed(back).columns == frame.columns and "__doc" not in moved.columns


def test_vectors_beyond_the_range_of_squares(spark):
    rows = [(0, [1e200, 0.0]), (1, [1e200, 1e200]), (2, [-1e300, 0.0]), (3, [2e200, -1e200]), (4, [1.0, 1.0]), (20, [3e-5, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(frame, F.col("vec_id") % 20 == 0, k=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert [v for v, _ in got[0]] == [3, 1, 4] and got[0][0][1] == float("inf")
    assert got[20][0] == (1, 1e200 * 1.0 + 1e200 * 3e-5) or got[20][0][0] == 1
    small = spark.createDataFrame([(0, [1.5, 2.0]), (1, [3.0, 1.0]), (2, [0.1, 0.7])], frame.schema)
    assert [(r.vec_id, r.score) for r in ann.nearest(small, F.col("vec_id") == 0, k=2).orderBy("rank").collect()] == [(1, 6.5), (2, 0.1 * 1.5 + 0.7 * 2.0)]


def test_records_and_labels_that_contradict(spark):
    kind = "record_id long, kind string, url string, date timestamp, headers array<struct<name:string,value:string>>, payload string"
    h = lambda v: [("ETag", v)]
    import datetime as dt

    day = lambda d: dt.datetime(2024, 1, d)
    rows = [(1, "response", "http://a/x", day(1), h("b"), "second"), (1, "response", "http://a/x", day(1), h("a"), "first"), (2, "revisit", "http://a/x", day(2), h("a"), None), (2, "revisit", "http://a/x", day(2), h("a"), None)]
    for frame in (spark.createDataFrame(rows, kind), spark.createDataFrame(rows[::-1], kind).repartition(3)):
        full = warc_revisit.with_payload(warc_revisit.resolve(frame), frame).collect()
        assert [(r.record_id, r.status, r.payload) for r in full] == [(2, "resolved", "first")]
    long = "x" * 300_000
    repeated = spark.createDataFrame([(1, "response", "http://a/x", day(1), h(long), long)] * 3 + [(2, "revisit", "http://a/x", day(2), h(long), None)], kind)
    assert [(r.status, len(r.payload)) for r in warc_revisit.with_payload(warc_revisit.resolve(repeated), repeated).collect()] == [("resolved", 300_000)]
    docs = spark.createDataFrame([(i, "you idiot" if i % 2 else "fine words here") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 0), (3, 0)], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, labels.repartition(5).orderBy(F.desc("toxic")))


def independent_fingerprint(text):
    """The contract's fingerprint from the words of the contract alone."""
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    grams = [" ".join(found[i : i + 3]) for i in range(len(found) - 2)] or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_fingerprints_written_out_anew(spark):
    texts = dict(connect(SF).execute("select doc_id, text from documents").fetchall())
    got = {r.doc_id: r.fingerprint for r in queries()["op10_simhash_golay"](spark, SF).collect()}
    assert got == {i: f"{independent_fingerprint(t):016x}" for i, t in texts.items()}


# ---- the pipeline on small tables ---------------------------------------------------------------


def tables(spark, folder, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, judged int, `__hash` string")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(1, " ".join(words(40, 50))), (2, None), (3, ""), (4, "What is 12 + 35?")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def row(i, text):
    return (i, text, "en", "s", len(text) if text is not None else None, 7, "h")


def stages(spark, folder):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = corpus_pipeline.new_folder(spark, "stage")
        stage(spark, docs, folder).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def test_pipeline_of_planted_cases(spark, tmp_path):
    base, other, long = words(400, 1), words(400, 2), words(60_000, 3)
    near = base.copy()
    near[100] = near[250] = "changed"  # ten of some 400 shingles
    apart = base[:150] + words(250, 4)
    passage = words(60, 5)
    rows = [
        row(1, " ".join(base)), row(2, " ".join(base)), row(2, " ".join(base)), row(3, " ".join(near)), row(4, " ".join(apart)), row(5, " ".join(other)),
        row(6, None), row(7, ""), row(8, " \n "), row(None, " ".join(words(30, 6))), row(None, " ".join(words(30, 7))),
        row(10, " ".join(words(20, 8) + words(40, 50) + words(20, 9))),  # holds an item of the benchmark
        row(11, "Now tell me: What is 12 + 35?"),
        row(12, " ".join(words(20, 10)) + "\n" + " ".join(passage)), row(13, " ".join(words(20, 11)) + "\n" + " ".join(passage)),
        row(14, "you idiot, you stupid moron, you worthless scum"), row(15, " ".join(long)), row(16, " ".join(long[:-5])),
    ]
    docs = tables(spark, str(tmp_path), rows)
    out = stages(spark, str(tmp_path))
    ids = lambda f: sorted((r.doc_id for r in f.select("doc_id").collect()), key=lambda x: (x is None, x))
    for name in list(out)[:-1]:
        assert out[name].columns == docs.columns and {(r.judged, r["__hash"]) for r in out[name].collect()} == {(7, "h")}
    assert 14 not in ids(out["toxicity"]) and len(ids(out["toxicity"])) == len(rows) - 1
    lines = {r.doc_id: r.text for r in out["line_dedup"].collect()}
    assert lines[12].endswith(passage[-1]) and passage[-1] not in lines[13] and 2 not in lines and {6, 7} <= lines.keys()
    near_out = ids(out["simhash_near_dedup"])
    assert 1 in near_out and 3 not in near_out and 4 in near_out and 5 in near_out and 15 in near_out and 16 not in near_out
    assert near_out.count(None) == 2 and sum(i in near_out for i in (6, 7, 8)) == 1  # texts without a word are one class
    clean = ids(out["benchmark_decontamination"])
    assert set(near_out) - set(clean) == {10, 11}
    assert ids(out["sentencepiece"]) == clean and all((r.ids is None) == (r.doc_id == 6) for r in out["sentencepiece"].collect())


def test_pipeline_of_empty_tables(spark, tmp_path):
    tables(spark, str(tmp_path), [])
    assert all(f.count() == 0 for f in stages(spark, str(tmp_path)).values())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_does_not_depend_on_order(spark, tmp_path):
    rows = [row(i, " ".join(words(60, i % 4) + [f"end{i // 8}"])) for i in range(16)]
    results = []
    for k, some in enumerate((rows, rows[::-1])):
        (tmp_path / str(k)).mkdir()
        tables(spark, str(tmp_path / str(k)), some)
        results.append(sorted((r.doc_id, r.ids) for r in stages(spark, str(tmp_path / str(k)))["sentencepiece"].collect()))
    assert results[0] == results[1] and len(results[0]) == 4


@pytest.mark.parametrize("edits", [1, 2, 3, 5])
def test_near_copies_from_the_similarity_on(spark, tmp_path, edits):
    """Planted copies with inner words changed: those of similarity 0.8 go, and so does no text below it."""
    docs, expected = [], 0
    for i in range(20):
        text = words(100, 100 + i)
        copy = text.copy()
        for e in range(edits):
            copy[10 + 12 * e] = f"edit{i}x{e}"
        sets = [{tuple(t[k : k + 5]) for k in range(96)} for t in (text, copy)]
        expected += len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1])
        docs += [row(2 * i, " ".join(text)), row(2 * i + 1, " ".join(copy))]
    frame = tables(spark, str(tmp_path), docs)
    assert corpus_pipeline.drop_near_duplicates(spark, frame, str(tmp_path)).count() == 40 - expected


# ---- toxicity scores written out anew -----------------------------------------------------------


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def plain_score(model, text, known):
    """The score by comparing every word with every term, and every quotation by counting marks from its line's start."""
    low = (text or "").lower()
    found = [(m[0], m.start()) for m in re.finditer(r"[^\W_]+", low)]
    words = [w for w, _ in found]
    sums = dict.fromkeys(("words", "misspelt", "stems", "quoted", "address"), 0.0)
    kinds, n = set(), 0
    for i, (word, at) in enumerate(found):
        if word not in known:
            hits = []
            for term in model.words:
                allowed = 2 if len(term) >= 9 else 1 if len(term) >= 5 else 0
                if abs(len(word) - len(term)) <= allowed and edit_distance(word, term) <= allowed:
                    hits.append((edit_distance(word, term), (term, edit_distance(word, term))))
            hits += [(1, (term, -1)) for term in model.stems if word.startswith(term)]
            known[word] = min(hits)[1] if hits and word not in model.struck else None
        if known[word] is None:
            continue
        term, errors = known[word]
        n += 1
        line = low[low.rfind("\n", 0, at) + 1 : at]
        low_marks = curly = 0
        for c in line:
            if c == "„":
                low_marks += 1
            elif c in "“”" and low_marks:
                low_marks -= 1
            elif c in "“”":
                curly += 1 if c == "“" else -1
        in_marks = line.count('"') % 2 == 1 or line.count("«") > line.count("»") or curly > 0 or low_marks > 0
        near = set(words[max(0, i - 6) : i + 7])
        weight = model.stems.get(term, 1.0) if errors < 0 else model.words.get(term, 1.0)
        if in_marks or near & toxicity.REPORT:
            sums["quoted"] += weight
            continue
        kinds.add(term)
        sums["stems" if errors < 0 else "misspelt" if errors else "words"] += weight
        sums["address"] += bool(near & toxicity.ADDRESS)
    x = [*(np.log1p(v) for v in sums.values()), min(1.0, 10 * n / max(1, len(words))), np.log1p(len(kinds))] if n else [0.0] * 7
    z = model.weights[0] + float(np.dot(model.weights[1:], x))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def test_scores_by_brute_force(spark):
    from wardline.llm.queries import train_rows

    frame = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(frame, train_rows(spark.read.parquet(f"{SF}/labels.parquet")))
    assert model.words
    odd = ['he said "you idiot" and left', "you idiot", "„du idiot” idiot", "« idiot » idiiot", "idiot\n“idiot\nidiot", None, "", "worthles worthlesss wrthles"]
    extra = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    both = frame.select("doc_id", "text").unionByName(extra)
    known = {}
    for r in both.select("doc_id", "text", toxicity.score(model, F.col("text")).alias("j")).collect():
        assert abs(r.j.score - plain_score(model, r.text, known)) < 1e-9, r.doc_id
