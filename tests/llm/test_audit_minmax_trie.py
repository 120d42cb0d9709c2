"""Filter audit, min-max near-dedup and the prefix trie against brute force and their SQL."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations, permutations

import duckdb
import numpy as np
import pytest

from quillstone.llm import audit, minmax, queries, trie

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = ("the", "an", "re", "ti", "on", "er", "in", "ed", "nd", "ou")
TURNS = "conv_id long, turn long, role string, text string"


def prose(r, n):
    return " ".join("".join(r.choices(SYLLABLES, k=r.randint(1, 3))) for _ in range(n))


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def document_rows():
    r = random.Random(11)
    base, long = prose(r, 260).split(), prose(r, 400)
    rows = [(i, prose(r, r.randint(1, 330)), r.choice(["en", "fr", None, ""])) for i in range(30)]
    for i in range(40, 70):  # near copies that differ more and more, so that some are linked by others only
        at = r.sample(range(len(base)), (i - 39) // 2)
        rows.append((i, " ".join(w + "x" if k in at else w for k, w in enumerate(base)), "en"))
    rows += [(80, long, "en"), (81, long.upper(), "fr"), (82, long, "en"), (82, long, "en"), (None, long, "en"), (None, long, None)]
    rows += [(90, None, "en"), (91, "", "en"), (92, " \t\n", None), (93, None, None), (None, None, None), (94, "one", "en"), (95, "ONE", "en"), (96, "one two", "en"), (97, "one one one", "de"), (98, "one one", "de")]
    rows += [(100, "#" + prose(r, 300), "es"), (101, "same words " * 300, "es"), (102, prose(r, 9000), "es"), (103, "é😀 Ñ " * 200, None), (104, "x" * 5000, "en"), (82, "another text of this id", "en")]
    rows += [(200, "a text that is there often " + prose(r, 30), "en")] * 40 + [(201 + i, "a text that many have", r.choice(["en", "de"])) for i in range(30)]
    return [(a, b, c, "s", 0) for a, b, c in rows]


ROWS = document_rows()
LABELS = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 230, 3)] + [(3, 0, 1), (82, 1, 0), (82, 0, 1), (None, 1, 1), (40, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SHAPE).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def rows_of(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)


def by_sql(name, **tables):
    base = duckdb.connect()
    for table, frame in tables.items():
        base.register(table, frame.toArrow())
    return base.sql(queries.ORACLES[name]).to_arrow_table()


# 11


def audit_by_hand():
    least = {}
    for doc_id, text, *_ in ROWS:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    good = {d for d, q, _ in LABELS if q == 1 and d is not None}
    toxic = {d for d, _, t in LABELS if t == 1 and d is not None}
    seen = []
    for doc_id, text, lang, *_ in ROWS:
        text, words = text or "", words_of(text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": doc_id is not None and doc_id > least[text]}
        seen.append((lang or "", {k for k, v in fails.items() if v}, doc_id in good, doc_id in toxic))
    out, shapley = Counter(), Counter()
    for part in {s[0] for s in seen}:
        for order in permutations("ABCDE"):
            alive = [s for s in seen if s[0] == part]
            everyone = alive
            for step, name in enumerate(order, 1):
                gone = [s for s in alive if name in s[1]]
                alive = [s for s in alive if name not in s[1]]
                shapley[part, name] += len(gone)
                out[part, "".join(order), step] = (len(alive), len(gone), sum(name in s[1] for s in everyone) - len(gone), sum(s[1] == {name} for s in everyone), sum(s[2] for s in gone), sum(s[3] for s in gone))
    return sorted(((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()), key=repr)


AUDIT = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_equals_brute_force(docs, labels):
    frame = audit.audit(docs, labels)
    assert frame.columns == list(AUDIT) and [f.dataType.simpleString() for f in frame.schema][1:] == ["string", "int", *["bigint"] * 7]
    found = rows_of(frame, *AUDIT)
    assert found == audit_by_hand()
    for name in "n_chars", "part", "good", "mask", "digest":
        docs = docs.withColumn(name, docs.text)
    assert rows_of(audit.audit(docs, labels.withColumn("part", labels.doc_id)), *AUDIT) == found


def test_audit_sql_agrees(docs, labels):
    some = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    table = by_sql("op11_filter_audit", documents=some, labels=labels)
    assert rows_of(audit.audit(some, labels), *AUDIT) == sorted((tuple(r[c] for c in AUDIT) for r in table.to_pylist()), key=repr)


def test_audit_of_empty_tables(spark, docs, labels):
    assert audit.audit(docs.where("false"), labels).count() == 0
    assert {r["good_lost"] for r in audit.audit(docs, labels.where("false")).collect()} == {0}


def test_audit_counts_a_common_text_by_part_and_task(spark, docs, labels):
    """Rows of one text meet as sums: a row a part and task, however many there are."""
    many = spark.range(6000, numPartitions=6).selectExpr("id AS doc_id", "'one text for all' AS text", "if(id % 3 = 0, 'en', 'fr') AS lang")
    found = {(r["part"], r["removed"]) for r in audit.audit(many, labels).where("filter_order = 'EABCD' AND step = 1").collect()}
    assert found == {("en", 1999), ("fr", 4000)}
    plan = audit.outcomes(many, labels)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


# 12


def shingles_of(text):
    low = [w.translate({c: c + 32 for c in range(65, 91)}) for w in words_of(text)]
    return frozenset(tuple(low[i : i + 2]) for i in range(max(1, len(low) - 1))) if low else frozenset()


def components_by_hand(rows):
    sets = [shingles_of(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return sorted(((r[0], len(sets[i]), least.get(find(i)) if sets[i] else r[0], r[0] == (least.get(find(i)) if sets[i] else r[0])) for i, r in enumerate(rows)), key=repr)


DEDUP = ("doc_id", "n_shingles", "component_id", "kept")


@pytest.mark.parametrize("block", [256, 4])
def test_minmax_dedup_equals_brute_force(docs, block):
    frame = minmax.near_dedup(docs.withColumn("node", docs.text).withColumn("bands", docs.doc_id), block)
    assert frame.columns == list(DEDUP)
    assert rows_of(frame, *DEDUP) == components_by_hand(ROWS)


def test_minmax_sql_agrees(docs):
    table = by_sql("op12_minmax_dedup", documents=docs.where("doc_id IS NOT NULL"))
    assert sorted((tuple(r.values()) for r in table.select(DEDUP).to_pylist()), key=repr) == components_by_hand([r for r in ROWS if r[0] is not None])


def test_minmax_finds_links_that_no_leader_has(spark):
    """Chains: neighbours are at the threshold, the ends are not, and blocks are small."""
    r = random.Random(3)
    base, rows = prose(r, 120).split(), []
    for i in range(90):
        base[(7 * i) % 120] = f"new{i}"
        rows.append((i, " ".join(base), None, None, 0))
    r.shuffle(rows)
    assert rows_of(minmax.near_dedup(spark.createDataFrame(rows, SHAPE), 3), *DEDUP) == components_by_hand(rows)


def test_minmax_values_estimate_similarity():
    r = np.random.default_rng(2)
    a, b = (np.unique(np.concatenate([r.integers(0, 1 << 63, 400, np.uint64), common])) for common in [r.integers(0, 1 << 63, 1600, np.uint64)] * 2)
    x, y = minmax.signature(a), minmax.signature(b)
    assert len(x) == 2 * minmax.PERMUTATIONS and abs((x == y).mean() - 1600 / 2400) < 0.15
    hashed = (a[None, :] >> np.uint64(32)).astype(np.uint32) ^ minmax._FLIP[:, None]
    assert (x == np.concatenate([(hashed * minmax._TIMES[:, None]).min(1), (hashed * minmax._TIMES[:, None]).max(1)])).all()


def test_minmax_of_empty_and_wordless_tables(docs):
    assert minmax.near_dedup(docs.where("false")).count() == 0
    assert rows_of(minmax.near_dedup(docs.where("doc_id = 90")), *DEDUP) == [(90, 0, 90, True)]


def test_minmax_of_many_copies(spark):
    rows = [(i, "the very same text for all of these rows", None, None, 0) for i in range(3000)] + [(5000, "the very same text for all of these rows ok", None, None, 0)] * 3000
    found = minmax.near_dedup(spark.createDataFrame(rows, SHAPE)).groupBy("component_id", "kept").count().collect()
    assert sorted(tuple(r) for r in found) == [(0, False, 5999), (0, True, 1)]


# 13


def turn_rows():
    r = random.Random(4)
    rows = []
    for c in [*range(100), -20, -21, -25, -40, 200, 205, 219, 7_000_000_021]:
        same = [(0, "user", "hello there"), (1, "assistant", "how can I help"), (2, "user", r.choice(["thanks", "no"])), (3, "assistant", "bye")]
        for turn, role, text in same[: r.randint(1, 4)]:
            rows.append((c, turn, role, text if r.random() < 0.9 else prose(r, 5)))
    for c in range(300, 340):  # exact copies, longer than any other
        rows += [(c, k, "user", f"turn {k}") for k in range(12)]
    rows += [(400, None, "user", "no number"), (400, 3, None, None), (400, 3, "user", None), (400, None, None, "x  y"), (400, 3, "user", None), (401, 0, "use", "rhello"), (402, 0, "user", "hello")]
    rows += [(500, k, "user", prose(r, 3)) for k in range(150)] + [(None, 0, "user", "of none"), (619, 0, "user", "alone without a base"), (None, None, None, None)]
    r.shuffle(rows)
    return rows


def trie_by_hand(rows):
    turns = {}
    key = lambda x: hashlib.sha256(f"{len((x[2] or '').encode())}:{x[2] or ''}{x[3] or ''}".encode()).hexdigest()
    for row in sorted((x for x in rows if x[0] is not None), key=lambda x: (x[1] is not None, x[1] or 0, key(x))):
        turns.setdefault(row[0], []).append((row[2] or "", row[3] or ""))
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = int(c - (abs(c) % 20) * (1 if c >= 0 else -1))
        rebuilt[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members = {}
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    out = []
    for path, inside in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = sum(not any(q[:-1] == p for q in below if len(q) == len(p) + 1) for p in below)
        saved = sum((len(members[p]) - 1) * len(words_of(p[-1][1])) for p in below if p)
        ends = ",".join(str(c) for c in sorted(inside) if len(rebuilt[c]) == len(path))
        out.append((min(inside), len(path), min(members[path[:-1]]) if path else None, len(inside), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_trie_equals_brute_force(spark):
    rows = turn_rows()
    frame = spark.createDataFrame(rows, TURNS).repartition(3)
    found = trie.prefix_trie(frame.withColumn("depth", frame.turn).withColumn("node", frame.text).withColumn("key", frame.role))
    assert found.columns == list(trie.NODE) and {f.dataType.simpleString() for f in found.schema[:-1]} == {"bigint"}
    assert rows_of(found, *trie.NODE) == trie_by_hand(rows)


def test_trie_sql_agrees(spark):
    rows = turn_rows()
    table = by_sql("op13_prefix_trie", conversations=spark.createDataFrame(rows, TURNS))
    assert sorted((tuple(r[c] for c in trie.NODE) for r in table.to_pylist()), key=repr) == trie_by_hand(rows)


def test_trie_of_few_conversations(spark):
    for rows in [[], [(5, 0, "user", "a b c")], [(20, k, "user", "a b") for k in range(3)], [(19, 0, "a", "b"), (39, 0, "a", "b")], [(None, 0, "a", "b")]]:
        assert rows_of(trie.prefix_trie(spark.createDataFrame(rows, TURNS)), *trie.NODE) == trie_by_hand(rows)


def test_trie_hashes_long_lists_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 7)
    rows = [(c, k, "user", f"turn {k}") for c in range(0, 4000, 20) for k in range(2)]
    assert rows_of(trie.prefix_trie(spark.createDataFrame(rows, TURNS)), *trie.NODE) == trie_by_hand(rows)
