"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardline.llm import ann, chat_format, decontaminate, license_scan, line_dedup, sentencepiece_codec, sharding, simhash, simhash_near, toxicity, warc_revisit
from wardline.llm.chat_template import Const, Print, TemplateError, Text, compile_template, fold, parse
from wardline.llm.components import components

DOCS = "doc_id long, text string"
CLASHING = "rank int, hash int, row int, node int, key int, seq int, words int, label string, score double, n_words int"


def docs(spark, *rows, clash=False):
    frame = spark.createDataFrame(list(rows), DOCS)
    if not clash:
        return frame
    return frame.selectExpr("*", *(f"cast(null as {x.split()[1]}) as {x.split()[0]}" for x in CLASHING.split(", ")))


def by_id(frame, *columns):
    return sorted(tuple(r[c] for c in ("doc_id", *columns)) for r in frame.collect())


# ---- chat formatting ----------------------------------------------------------------------------


def render(template, messages):
    return list(compile_template(template, chat_format.FILTERS)(messages))


def test_template_language():
    source = "{% set who = 'bot' %}{% for m in messages %}{% if loop.first %}#{% elif m.role == 'u' and not false %}U{% else %}{{ who | upper }}{% endif %}{{ m.text }}{% endfor %}."
    messages = [{"role": "u", "text": "a"}, {"role": "u", "text": "b"}, {"role": "x", "text": "c"}]
    assert render(source, messages) == [("#a", []), ("Ub", []), ("BOTc", []), (".", [])]


def test_template_folding():
    tree = fold(parse("a{{ 'b' + 'c' | upper }}{% if 1 == 2 %}x{% else %}d{% endif %}{{ m }}", chat_format.FILTERS), chat_format.FILTERS)
    assert tree[0] == Text("abCd") and isinstance(tree[1], Print) and not isinstance(tree[1].value, Const)


def test_template_marks_generation():
    assert render("{% for m in messages %}>{% generation %}{{ m.text }}{% endgeneration %}<{% endfor %}", [{"text": "ab"}, {"text": ""}]) == [(">ab<", [(1, 3)]), ("><", [])]


@pytest.mark.parametrize("wrong", ["{{ m.__class__ }}", "{{ f() }}", "{% for m in x %}{% endfor %}", "{% if true %}", "{{ 'a' | nope }}", "{% import x %}", "{{ }}", "{{ 1 2 }}", "{{ (1 }}"])
def test_template_sandbox(wrong):
    with pytest.raises(TemplateError):
        compile_template(wrong, chat_format.FILTERS)


PIECES = st.lists(st.sampled_from(["\\", "<turn>", "</turn>", "\n", "<", "a", "### Assistant:", "é"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "x\\\n<turn>"]), PIECES), max_size=4))
def test_escaping_round_trip(turns):
    chunks = render(chat_format.TEMPLATE, [{"role": r, "text": t} for r, t in turns])
    whole = "".join(c for c, _ in chunks)
    assert [(chat_format.unfield(m[1]), chat_format.unescape(m[2])) for m in chat_format.MESSAGE.finditer(whole)] == turns
    said = [chat_format.unescape(c[a:b]) for c, spans in chunks for a, b in spans]
    assert said == [t for r, t in turns if r == "assistant" and t]


def test_chat_rows(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "x" * 50_000), (None, 0, None, "q"), (2, 0, "assistant", "same"), (2, 0, "assistant", "same")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as place", "2 as formatted")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(frame)).collect()}
    assert {k: (r.n_turns, r.loss_chars) for k, r in got.items()} == {1: (2, 0), None: (1, 0), 2: (2, 8)}
    assert chat_format.read_back(chat_format.format_conversations(frame.limit(0))).count() == 0


# ---- license scan -------------------------------------------------------------------------------


def test_license_places(spark):
    text = "x Under the MIT-License y under the mit license " + "w " * 30_000 + "Apache License, Version 2.0 CC BY NC"
    frame = docs(spark, (1, text), (2, None), (3, ""), (4, "under the mit lICENSE"), (4, "under the mit lICENSE"), (5, "under the mıt license"), (6, "cc by"), clash=True)
    got = by_id(license_scan.scan(frame), "n_words", "n_base", "first_word", "last_word", "base_labels")
    none = (0, None, None, "")
    assert got == [(1, 30_018, 4, 1, 30_015, "apache-2,cc-by-nc,mit"), (2, 0, *none), (3, 0, *none), (4, 4, 1, 0, 0, "mit"), (4, 4, 1, 0, 0, "mit"), (5, 4, *none), (6, 2, *none)]
    assert license_scan.scan(frame.limit(0)).count() == 0


def test_license_with_changed_words(spark):
    notice = "Permission is hereby granted, free of charge, to any person obtaining one copy of this software and associated documentation files"
    got = license_scan.scan(docs(spark, (1, "a b " + notice), (2, "permission is hereby granted"))).orderBy("doc_id").collect()
    assert [(r.labels, r.n_base) for r in got] == [("mit", 0), ("", 0)] and 0 < got[1].score < 0.8 <= got[0].score


# ---- neighbours ---------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>"


def test_neighbours_ties_and_unusable(spark):
    same = [(i, [1.0, 0.0]) for i in range(40)]
    rows = [*same, (100, [0.0, 0.0]), (101, None), (102, [float("nan"), 1.0]), (103, [None, 1.0]), (104, []), (None, [1.0, 1.0]), (120, [2.0, 0.0]), (140, [1.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 as rank", "2 as score", "3 as p")
    got = {}
    for r in ann.nearest(frame, F.col("vec_id") % 20 == 0, k=3, leaf=4, cell_rows=10, block_rows=8, query_rows=2).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got == {0: [(1, 120, 2.0), (2, 1, 1.0), (3, 2, 1.0)], 20: [(1, 120, 2.0), (2, 0, 1.0), (3, 1, 1.0)], 120: [(1, 0, 2.0), (2, 1, 2.0), (3, 2, 2.0)]}
    assert ann.nearest(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_chi_square_quantile():
    assert abs(ann.chi_square_quantile(0.95, 8) - 15.507313) < 1e-5


# ---- toxicity -----------------------------------------------------------------------------------


def test_automaton_finds_misspellings():
    match = toxicity.Matcher(toxicity.Model(words={"stupid": 1.0, "worthless": 1.0, "ape": 1.0}, stems={"idio": 1.0}, struck=frozenset({"stupi"})))
    found = {w: match(w) for w in ("stupid", "stupd", "stuupid", "xtupid", "stpd", "stupi", "wrthles", "worthlessly", "ape", "ap", "idiotic", "idi", "", "zzz")}
    assert found == {
        "stupid": ("stupid", 0), "stupd": ("stupid", 1), "stuupid": ("stupid", 1), "xtupid": ("stupid", 1), "stpd": None, "stupi": None,
        "wrthles": ("worthless", 2), "worthlessly": ("worthless", 2), "ape": ("ape", 0), "ap": None, "idiotic": ("idio", -1), "idi": None, "": None, "zzz": None,
    }


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, left = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(left[j] + 1, row[-1] + 1, left[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=11), st.lists(st.text("abc", min_size=1, max_size=10), min_size=1, max_size=4, unique=True))
def test_automaton_equals_edit_distance(word, terms):
    hit = toxicity.Matcher(toxicity.Model(words=dict.fromkeys(terms, 1.0)))(word)
    allowed = lambda t: 2 if len(t) >= 9 else 1 if len(t) >= 5 else 0
    near = [levenshtein(word, t) for t in terms if levenshtein(word, t) <= allowed(t)]
    assert (hit is None) == (not near) and (hit is None or hit[1] == min(near) == levenshtein(word, hit[0]))


def test_quotation_scores_lower_than_abuse():
    scorer = toxicity.Scorer(toxicity.Model())
    score = lambda t: scorer.score(scorer.features(*scorer.matches(t)))
    assert score("nice words") < score('they said "idiot" to him') < score("you idiot") and score("") == score("nice words")


def test_toxicity_rows(spark):
    frame = docs(spark, (1, "you stupid idiot"), (1, "you stupid idiot"), (2, None), (3, ""), (4, "fine " * 20_000), clash=True)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(frame, labels)
    assert model == toxicity.Model()
    got = by_id(frame.select("doc_id", toxicity.score(model, F.col("text")).alias("j")).select("doc_id", "j.score", "j.terms"), "score", "terms")
    assert got[0] == got[1] and got[0][1] > 0.3 and got[0][2] == ["idiot", "stupid"] and {s for i, s, _ in got if i > 1} == {got[2][1]} and got[2][1] < 0.3
    assert frame.limit(0).select(toxicity.score(model, F.col("text"))).count() == 0


def test_lexicon_prefers_words_to_their_stems():
    words, stems = toxicity.choose([("vile", False, 50, 0), ("vil", True, 52, 0), ("foul", True, 40, 0), ("fouly", False, 10, 0), ("the", False, 60, 600)], 100, 900, 3.0)
    assert set(words) == {"vile"} and set(stems) == {"foul"}


# ---- sharding -----------------------------------------------------------------------------------


def jump_reference(key, shards):
    b, j = -1, 0
    while j < shards:
        b, key = j, (key * sharding.MULTIPLIER + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_jump_equals_reference(spark):
    keys = [0, 1, 2**64 - 1, 2**63, 12345678901234567890, *range(1000, 1100)]
    frame = spark.createDataFrame([(str(k),) for k in keys], "k string").select("k", *(sharding.jump(F.col("k").cast("decimal(20,0)"), n).alias(f"s{n}") for n in (1, 2, 16, 17, 100)))
    for r in frame.collect():
        assert [r[f"s{n}"] for n in (1, 2, 16, 17, 100)] == [jump_reference(int(r.k), n) for n in (1, 2, 16, 17, 100)]


def test_shards_grow_and_slots_have_no_gaps(spark):
    rows = [(i, f"text {i}") for i in range(500)] + [(7, "again")] * 50 + [(None, None), (None, ""), (8, "x" * 100_000)]
    got = sharding.assign(docs(spark, *rows, clash=True)).collect()
    assert len(got) == len(rows) and all(r.grown_shard in (r.shard, 16) for r in got)
    for shard in range(16):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert len({r.shard for r in got if r.doc_id == 7}) == 1 and sorted(r.size for r in got)[-1] == 100_001
    assert sharding.assign(docs(spark, *rows).limit(0)).count() == 0


def test_key_column_keeps_equal_texts_together(spark):
    got = sharding.assign(docs(spark, *((i, f"t{i % 3}") for i in range(90))), key_column="text").collect()
    assert len({(r.text_crc32, r.shard) for r in got}) == 3


def test_quotation_on_a_long_line():
    far = "plain " * 100
    flags = lambda t: [m[3] for m in toxicity.Scorer(toxicity.Model()).matches(t)[0]]
    assert flags(f'"{far}" idiot') == [False] and flags(f'"{far} idiot" moron') == [True, False]
    assert flags(f"„{far}“ idiot") == [False] and flags(f"“{far} idiot” scum\n“open\nscum") == [True, False, False]


# ---- decontamination ----------------------------------------------------------------------------

ITEM = "a train leaves the station with 12 wagons and Anna counts 12 lamps behind every second window"


def test_decontamination(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, ITEM), (3, None), (4, "too short")], "item_id long, text string")
    other = ITEM.replace("12", "3.50").replace("Anna", "Bert")
    mixed = ITEM.replace("12", "7", 1)
    rows = [(1, "Intro text. " + ITEM + " more"), (2, other), (3, mixed), (4, None), (5, ""), (6, "plain " * 30_000 + ITEM.upper()), (7, "x " + ITEM), (7, "x " + ITEM), (None, ITEM)]
    frame = docs(spark, *rows, clash=True)
    found = decontaminate.hits(frame, bench).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.coverage) for r in found) == [(0, 1, 1.0), (1, 1, 1.0), (2, 1, 1.0), (7, 1, 1.0)]
    by_shuffle = decontaminate.hits(frame, bench, broadcast_rows=0).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, by_shuffle))
    kept = decontaminate.clean(frame, bench)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]
    assert decontaminate.hits(frame.limit(0), bench).count() == 0 and decontaminate.clean(frame, bench.limit(0)).count() == len(rows)


def test_edited_items(spark):
    alice = "Alice has 3 apples. Alice buys 4 more apples. How many apples does Alice have?"
    sam = "Sam bought 12 pens. Each pen costs 3 dollars and the shop gives one pen for free. Sam paid with a note."
    plain = "the quick river carries seven old boats past the silent mill at night"
    bench = spark.createDataFrame([(1, alice), (2, sam), (3, plain)], "item_id long, text string")
    one = [" ".join(w if i != at else "changed" for i, w in enumerate(plain.split())) for at in range(13)]
    rows = [
        (100, "Look: " + alice.replace("Alice", "Bob").replace("3", "5") + " Thanks."), (101, sam.replace("Sam", "Joe")), (102, "x " + alice + " In Apples. " + sam),
        *enumerate(one), (13, plain.replace("seven", "seven very")),
        (200, "Bob has 3 apples. Carl buys 4 pears. How many apples does Alice have?"), (201, "the quick river carries seven red cars along a road that nobody knows"),
    ]
    assert sorted(r.doc_id for r in decontaminate.clean(docs(spark, *rows), bench).collect()) == [200, 201]


def test_items_without_windows(spark):
    bench = spark.createDataFrame([(1, "What is 12 + 35?"), (2, "What is 12 * 7 - 5 + 9?"), (3, None), (4, ""), (5, "?!"), (6, "Name Ada Byron")], "item_id long, text string")
    rows = [
        (1, "Ask: what is 12 +\n35? Yes."), (2, "What is 12 * 7 - 5 + 9?"), (3, "name Ada Byron"), (4, None), (5, ""), (6, "?!"),
        (7, "What is 12 - 35?"), (8, "What is 12 + 350?"), (9, "What is 12 * 7 - 5?"), (10, "rename Ada Byron"),
    ]
    assert sorted(r.doc_id for r in decontaminate.clean(docs(spark, *rows), bench).collect()) == [4, 5, 6, 7, 8, 9, 10]
    assert decontaminate.clean(docs(spark, *rows), bench.where("item_id in (3, 4, 5)")).count() == len(rows)


# ---- line dedup ---------------------------------------------------------------------------------


def words(n, tag):
    return " ".join(f"{tag}{i}" for i in range(n))


def test_line_dedup(spark):
    a, b, c = words(60, "a"), words(30, "b"), words(30, "c")
    rows = [
        (1, f"{a}\nx\n{b}\n\n{c}"), (2, f"y\n{a}"), (3, f"{b}\n{c}\nz"), (4, b), (5, f"{c}\n{b}"), (6, None), (7, ""), (8, f"{a}\n{a}\nshort"),
        (9, "u\n" * 3000 + a), (10, f"{words(80, 'd')}\nx"), (10, f"{words(80, 'd')}\nx"),
    ]
    frame = docs(spark, *rows, clash=True)
    got = line_dedup.dedupe(frame)
    assert got.columns == [*frame.columns, "n_lines", "n_removed"]
    kept = {r.doc_id: (r.text, r.n_removed) for r in got.collect()}
    assert kept[1][1] == 0 and kept[2] == ("y", 1) and kept[3] == ("z", 2) and kept[4] == (b, 0) and kept[5] == (f"{c}\n{b}", 0)
    assert kept[6] == (None, 0) and kept[7] == ("", 0) and kept[8] == ("short", 2) and kept[10][1] == 0
    # Of a line repeated on and on one stays, since every later run also stands one line earlier.
    assert kept[9] == ("u", 3000) and got.count() == len(rows)
    assert line_dedup.dedupe(frame.limit(0)).count() == 0


def test_line_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "\n".join(" ".join(["w"] * int(rng.integers(1, 6))) + f" {rng.integers(0, 6)}" for _ in range(rng.integers(0, 12)))) for i in range(60)]
    limit = 8
    sequences = {i: [x for x in t.split("\n") if x.strip()] for i, t in rows}
    first, spans = {}, []
    for i, lines in sequences.items():
        for s in range(len(lines)):
            for e in range(s + 1, len(lines) + 1):
                if sum(len(x.split()) for x in lines[s:e]) >= limit:
                    first.setdefault(tuple(lines[s:e]), (i, s))
                    spans.append((i, s, e))
    gone = {(i, k) for i, s, e in spans if first[tuple(sequences[i][s:e])] < (i, s) for k in range(s, e)}
    expected = {i: sum((i, k) in gone for k in range(len(x))) for i, x in sequences.items()}
    got = {r.doc_id: r.n_removed for r in line_dedup.dedupe(docs(spark, *rows), min_words=limit).collect()}
    assert got == expected and sum(expected.values()) > 20


# ---- SentencePiece ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return sentencepiece_codec.load()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_pieces_round_trip(text):
    encoder, decoder = coder()
    assert decoder(np.frombuffer(encoder(text), dtype="<i4")) == text


_coder = []


def coder():
    if not _coder:
        loaded = sentencepiece_codec.load()
        _coder.append((sentencepiece_codec.Encoder(loaded, remembered=50), sentencepiece_codec.Decoder(loaded)))
    return _coder[0]


@settings(max_examples=100, deadline=None)
@given(st.text("aenrst he.,é\n", max_size=14))
def test_pieces_are_the_best_segmentation(text):
    encoder, _ = coder()
    scores = {p: s for p, s, _ in sentencepiece_codec.load().pieces} if not hasattr(coder, "scores") else coder.scores
    coder.scores = scores
    marked = "▁" + text.replace(" ", "▁")
    best = [0.0] + [-1e18] * len(marked)
    for end in range(1, len(marked) + 1):
        for start in range(max(0, end - 16), end):
            piece = marked[start:end]
            cost = scores.get(piece, encoder.penalty if len(piece) == 1 else None)
            if cost is not None:
                best[end] = max(best[end], best[start] + cost)
    by_id = {i: s for _, s, i in sentencepiece_codec.load().pieces} if not hasattr(coder, "by_id") else coder.by_id
    coder.by_id = by_id
    ids = np.frombuffer(encoder(text), dtype="<i4").tolist()
    strange = [c for c in marked if c not in scores]
    total = sum(by_id[i] for i in ids if i in by_id) + len(strange) * encoder.penalty
    assert not text or abs(total - best[-1]) < 1e-6


def test_pieces_equal_the_library(spark):
    """The lattice Viterbi of the library (its unigram mode over the same pieces and scores), word by word."""
    pytest.importorskip("google.protobuf")
    import sentencepiece
    from conftest import SF
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(sentencepiece_codec.MODEL, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = 1
    library, (encoder, _) = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString()), coder()
    words = {w for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect() for w in r.text.split()}
    score = lambda ids: sum(library.get_score(i) for i in ids)
    ours = {w: np.frombuffer(encoder(w), dtype="<i4").tolist() for w in words}
    theirs = {w: library.nbest_encode_as_ids(w, 2)[0] for w in words}
    # Segmentations of equal score may differ, and do in a few words.
    assert len(words) > 1000 and all(score(ours[w]) == score(theirs[w]) for w in words)
    assert sum(ours[w] != theirs[w] for w in words) < len(words) / 500


def test_pieces_rows(spark, vocabulary):
    texts = [None, "", " ", "▁", "a▁b c", "x" * 60_000, "same", "same", "tab\tline\n🙂 ẞ"]
    frame = docs(spark, *enumerate(texts), clash=True)
    coded = frame.withColumn("ids", sentencepiece_codec.encode(spark, vocabulary, F.col("text")))
    back = coded.withColumn("back", sentencepiece_codec.decode(spark, vocabulary, F.col("ids"))).orderBy("doc_id").collect()
    assert [r.back for r in back] == texts and back[0].ids is None and back[1].ids == [] and back[6].ids == back[7].ids
    assert coded.limit(0).count() == 0


def test_arrow_slices(vocabulary):
    decoder = sentencepiece_codec.Decoder(vocabulary)
    ids = pa.array([[1554], None, [1554, 1554]], pa.list_(pa.int32())).slice(1)
    assert ids.offsets.to_pylist() == [1, 1, 3] and decoder(np.array([], dtype=np.int32)) == ""


# ---- revisits -----------------------------------------------------------------------------------

RECORDS = "record_id long, kind string, url string, date string, headers array<struct<name:string,value:string>>, payload string"


def test_revisits(spark):
    h = lambda **x: [(k.replace("_", "-"), v) for k, v in x.items()]
    rows = [
        (1, "response", "http://www.A.com:80/p/?b=2&a=1&utm_source=x#f", "2024-01-01 00:00:00", h(ETag="e1", Content_Length="3", Cache_Control="old"), "one"),
        (2, "response", "https://a.com/p?a=1&b=2", "2024-01-01 00:30:00", h(ETag="e2", Last_Modified="m2"), "two"),
        (3, "revisit", "a.com/p?a=1&b=2", "2024-01-01 00:10:00", h(etag="W/e1", Content_Length="0", cache_control="new", X="y"), None),
        (4, "revisit", "http://a.com/p?b=2&a=1", "2024-01-03 00:00:00", h(etag="e1"), None),
        (5, "revisit", "http://a.com/p?b=2&a=1", "2024-01-03 00:00:00", h(last_modified="m2"), None),
        (6, "revisit", "http://a.com/p?b=2&a=1", "2023-01-01 00:00:00", None, None),
        (7, "revisit", "http://a.com/p?b=2&a=1", "2024-02-01 00:00:00", None, None),
        (7, "revisit", "http://a.com/p?b=2&a=1", "2024-02-01 00:00:00", None, None),
        (8, "revisit", None, None, None, None), (9, "request", "http://a.com/p?b=2&a=1", "2024-01-01 00:00:01", None, "no"),
        (10, "response", "b.com", None, h(etag="z"), ""), (11, "revisit", "b.com/", None, h(etag="z"), None),
    ]
    frame = spark.createDataFrame(rows, RECORDS).withColumn("date", F.to_timestamp("date")).selectExpr("*", "1 as bucket", "2 as status")
    got = {r.record_id: r for r in warc_revisit.with_payload(warc_revisit.resolve(frame), frame).collect()}
    assert {k: (r.response_id, r.status, r.payload) for k, r in got.items()} == {
        3: (1, "resolved", "one"), 4: (2, "changed", None), 5: (2, "resolved", "two"), 6: (None, "missing", None), 7: (2, "unvalidated", None),
        8: (None, "missing", None), 11: (10, "resolved", ""),
    }
    assert [tuple(x) for x in got[3].headers] == [("cache-control", "new"), ("content-length", "3"), ("etag", "W/e1"), ("x", "y")]
    assert warc_revisit.resolve(frame.limit(0)).count() == 0


# ---- SimHash ------------------------------------------------------------------------------------


def test_golay_code_is_perfect():
    parity, error = simhash.code()
    assert len(set(error.tolist())) == 2048 and max(int(e).bit_count() for e in error) == 3
    words = np.random.default_rng(0).integers(0, 1 << 23, 2000, dtype=np.int32)
    index = simhash.codeword_index(words, (parity, error))
    codewords = (index << 11) | parity[index]
    assert max(int(x).bit_count() for x in words ^ codewords) <= 3


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=2))
def test_two_bits_share_a_key(word, flips):
    other = word
    for f in flips:
        other ^= 1 << f
    rows, values, own = simhash.keys(np.array([word, other], dtype=np.uint64), simhash.code())
    assert set(values[rows == 0].tolist()) & set(values[(rows == 1) & own].tolist())


def test_crowded_keys_lose_no_link(spark):
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 2**63))
    prints = sorted({base ^ int(sum(1 << int(b) for b in rng.choice(62, size=rng.integers(0, 4), replace=False))) for _ in range(150)})
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    few = {tuple(r) for r in components(simhash.links(frame, crowd=2), "a", "b").collect()}
    all_pairs = {tuple(r) for r in components(simhash.links(frame, crowd=10_000), "a", "b").collect()}
    near = {p for p in prints for q in prints if p != q and (p ^ q).bit_count() <= 2}
    assert few == all_pairs and {n for n, _ in few} == near


def test_simhash_rows(spark):
    long = " ".join(f"w{i % 997}" for i in range(150_000))
    frame = docs(spark, (3, "A b C d"), (1, "a B c D"), (9, None), (4, ""), (5, " \t"), (6, "É"), (7, "é"), (None, "a b c d"), (8, long), (8, long), clash=True)
    got = sorted(((r.doc_id, r.fp, r.component_id) for r in simhash.groups(frame).collect()), key=repr)
    named = {(i, c) for i, _, c in got}
    assert named == {(3, 1), (1, 1), (None, 1), (9, 4), (4, 4), (5, 4), (6, 6), (7, 7), (8, 8)} and len(got) == 10
    assert {f for i, f, _ in got if i in (4, 5, 9)} == {0}
    assert simhash.fingerprint(long.encode(), 3, 42) == simhash.fingerprint(long.upper().encode(), 3, 42)
    assert simhash.groups(frame.limit(0)).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 200), (200, 300)], "a long, b long")
    got = dict(map(tuple, components(edges, "a", "b").collect()))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 300: 200}


def test_near_duplicates(spark):
    rng = np.random.default_rng(5)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    base = fresh(300)
    one = base[:150] + ["changed"] + base[151:]
    four = base.copy()
    for at in (20, 90, 200, 280):
        four[at] = "other"
    rows = [(5, " ".join(base)), (2, " ".join(one)), (3, "\n".join(four).upper()), (4, " ".join(fresh(300))), (6, None), (7, ""), (8, "a b"), (9, "A  b"), (9, "A  b"), (None, " ".join(base)), (10, "a c")]
    frame = docs(spark, *rows, clash=True)
    kept = simhash_near.dedupe(frame)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [2, 4, 6, 8, 10]
    assert simhash_near.dedupe(frame.limit(0)).count() == 0


def test_near_duplicates_of_real_texts(spark):
    """Every pair of similarity 0.9 is in one group, and no group holds a pair that no chain of 0.8 links joins."""
    from conftest import SF

    frame = spark.read.parquet(f"{SF}/documents.parquet")
    shingle = lambda t: frozenset(zip(*((t or "").lower().split()[i:] for i in range(5)))) or frozenset([tuple((t or "").lower().split())])  # noqa: E731, B905
    sets = {r.doc_id: shingle(r.text) for r in frame.collect()}
    first = {r["__doc"].v: r["first"]["__doc"].v for r in simhash_near.groups(frame).collect()}
    ids = sorted(sets)
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert all(first[a] == first[b] for a in ids for b in ids if a < b and sets[a] & sets[b] and like(a, b) >= 0.9)
    for a in ids:
        if first[a] != a:
            assert any(b != a and first[b] == first[a] and like(a, b) >= 0.8 for b in ids)


def shingle_links(frame, similarity=0.8):
    """Brute force: the pairs of ids whose sets of five-word shingles have the similarity."""
    split = {r.doc_id: r.text.lower().split() for r in frame.collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in split.items()}
    ids = sorted(sets)
    return [(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]


def same_groups(frame):
    first = {r["__doc"].v: r["first"]["__doc"].v for r in simhash_near.groups(frame).collect()}
    linked = shingle_links(frame)
    rows = [(i, i) for i in first] + linked
    root = {i: i for i in first}
    for _ in rows:  # the smallest id travels along the links
        before = dict(root)
        for a, b in rows:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    return linked, {i for i in first if first[i] != root[i]}


def test_near_duplicates_under_crowded_keys(spark):
    """Pairs of similarity 0.8 to 0.85 among 300 texts that share a long passage with them (similarity 0.4 to 0.7)."""
    rng = np.random.default_rng(11)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    passage = fresh(70)
    family = [passage + fresh(int(n)) for n in rng.integers(30, 60, 300)]
    pairs = []
    for _ in range(30):
        text = passage + fresh(45)
        near = text.copy()
        near[80] = near[100] = "other"
        pairs += [text, near]
    frame = docs(spark, *((i, " ".join(t)) for i, t in enumerate(family + pairs)))
    linked, wrong = same_groups(frame)
    assert len(linked) == 30 and not wrong


def test_near_duplicates_at_the_threshold(spark):
    """Every pair of similarity 0.8 to 0.85 is found, long and short, down to texts of a single shingle."""
    rng = np.random.default_rng(12)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    texts = []
    for n in range(50, 450, 10):  # inner words changed: each takes five shingles
        text = fresh(n)
        near = text.copy()
        for at in range(10, 10 + 10 * int((n - 4) / 46), 10):
            near[at] = "other"
        texts += [text, near]
    for n in range(8, 40):  # words added at the end, as many as the similarity allows
        text = fresh(n)
        texts += [text, text + fresh((n - 4) // 4)]
    texts += [["a"] * 5, ["a"] * 6, ["b"] * 4, ["b"] * 5]
    frame = docs(spark, *((i, " ".join(t)) for i, t in enumerate(texts)))
    linked, wrong = same_groups(frame)
    assert len(linked) == 40 + 32 + 1 and not wrong


def test_no_word_of_a_template_is_lost():
    assert all(re.fullmatch(r"[a-z0-9 ]+", t) for t in [*license_scan.PHRASES, *license_scan.NOTICES])
