"""Every query of the subpackage against its SQL or a brute-force version, at the smallest scale."""

import collections
import hashlib

import numpy as np
import pytest
from compare import connect, difference
from conftest import SF

from wardline.llm.queries import CONTROL_TEXT, queries
from wardline.llm.simhash import fingerprint
from wardline.llm.sql import oracle_sql

QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_all_thirteen_are_there():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14)) and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    assert difference(QUERIES[name](spark, SF), duck, SQL[name]) is None


def test_chat_format(spark, duck):
    turns = collections.defaultdict(list)
    for conv, _, role, text in duck.execute("select conv_id, turn, role, coalesce(text, '') from conversations order by 1, 2").fetchall():
        turns[conv].append((role, text))
    turns[-7] = [("user", CONTROL_TEXT), ("assistant", CONTROL_TEXT)]
    got = {r[0]: tuple(r)[1:5] for r in QUERIES["op1_chat_format"](spark, SF).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    said = {c: "".join(x for r, x in t if r == "assistant") for c, t in turns.items()}
    assert got == {c: (len(t), digest("".join(f"{r}\n{x}\n" for r, x in t)), len(said[c]), digest(said[c])) for c, t in turns.items()}


def test_neighbours(spark, duck):
    rows = duck.execute("select vec_id, embedding from embeddings order by 1").fetchall()
    ids, vectors = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    got = collections.defaultdict(list)
    for r in QUERIES["op3_srs_neighbours"](spark, SF).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for at in np.flatnonzero(ids % 20 == 0):
        scores = vectors @ vectors[at]
        best = [ids[j] for j in np.lexsort((ids, -scores)) if j != at][:20]
        mine = got[ids[at]]
        assert [r for r, _, _ in mine] == list(range(1, 21)) and [s for *_, s in mine] == sorted((s for *_, s in mine), reverse=True)
        assert all(abs(scores[np.flatnonzero(ids == v)[0]] - s) < 1e-12 for _, v, s in mine)
        hits, total = hits + len(set(best) & {v for _, v, _ in mine}), total + len(best)
    assert hits / total >= 0.9


def test_simhash(spark, duck):
    docs = duck.execute("select doc_id, encode(text) from documents order by 1").fetchall()
    prints = {i: fingerprint(t, 3, 42) for i, t in docs}
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 2 and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    got = {tuple(r) for r in QUERIES["op10_simhash_golay"](spark, SF).collect()}
    assert got == {(i, f"{p:016x}", find(i)) for i, p in prints.items()}


def test_sentencepiece(spark):
    rows = QUERIES["op8_sentencepiece"](spark, SF).collect()
    assert rows and all(r.round_trip and r.n_ids == len(r.ids) for r in rows)


def test_toxicity_holds_out_a_quarter(spark, duck):
    rows = QUERIES["op4_toxicity"](spark, SF).collect()
    toxic = dict(duck.execute("select doc_id, toxic from labels").fetchall())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    known = [(toxic[r.doc_id], r.predicted) for r in rows if r.doc_id in toxic and r.held_out]
    assert known and np.mean([a == b for a, b in known]) > 0.85
