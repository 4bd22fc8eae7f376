"""Operators 11 to 13 against brute force."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from harness import SF_DIR

from lodeweave.llm import repair, simhash, vector_codes

# ---- 11


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids, distance=4):
    root = list(range(len(prints)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in itertools.combinations(range(len(prints)), 2):
        if (prints[x] ^ prints[y]).bit_count() <= distance:
            root[top(x)] = top(y)
    least = {}
    for x, i in enumerate(ids):
        if i is not None:
            least[top(x)] = min(i, least.get(top(x), i))
    return [least.get(top(x)) for x in range(len(prints))]


def test_op11_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    prints = [plain_fingerprint(r["text"]) for r in docs]
    want = sorted((r["doc_id"], f"{p:016x}", c) for r, p, c in zip(docs, prints, plain_components(prints, [r["doc_id"] for r in docs])))
    assert sorted(map(tuple, simhash.op11_simhash(spark, SF_DIR).select("doc_id", "fingerprint", "component_id").collect())) == want


def test_op11_fingerprint_of_pieces(monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice(["Ab", "é", " ", "\n", "\x0b", " ", "x" * 40]) + rng.choice([" ", ""]) for _ in range(3000))
    whole = simhash.fingerprint(text)
    assert whole == plain_fingerprint(text)
    for size in (1, 7, 100):
        monkeypatch.setattr(simhash, "PIECE", size)
        assert simhash.fingerprint(text) == whole
    for t in (None, "", " \n", "One", "one two", "a b c d", "a b c d e"):
        assert simhash.fingerprint(t) == plain_fingerprint(t)


@pytest.mark.parametrize("block", [8, 4096])
def test_op11_links_of_planted_fingerprints(spark, block):
    """Dense groups, chains of 4-bit steps and pairs that are 5 bits apart; with small blocks every variant counts as very large."""
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(150)}
    center = rng.getrandbits(64)
    prints |= {center ^ sum(1 << b for b in rng.sample(range(0, 12), rng.randint(0, 6))) for _ in range(300)}
    at = rng.getrandbits(64)
    for _ in range(40):
        at ^= sum(1 << b for b in rng.sample(range(64), 4))
        prints.add(at)
    far = rng.getrandbits(64)
    prints |= {far, far ^ 0b11111 << 30, far ^ (1 << 63 | 1 << 42 | 1 << 21 | 1 << 5)}
    prints = sorted(prints)
    scratch = simhash.Scratch(spark)
    nodes = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    nodes = scratch.save(nodes)
    got = {r["node"]: r["label"] for r in simhash.components(scratch, simhash.links(scratch, nodes, 4, block)).collect()}
    groups = {}
    for p in prints:
        s = p - (1 << 64) if p >> 63 else p
        groups.setdefault(got.get(s, s), set()).add(p)
    want = {}
    for p, c in zip(prints, plain_components(prints, list(range(len(prints))))):
        want.setdefault(c, set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_op11_odd_rows(spark):
    rows = [(None, None, 1), (4, "", 1), (3, " \n", 1), (7, "same words in here today", 2), (7, "same words in here today", 2), (5, "SAME words  in here today", 3), (None, "something else is written here", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(map(tuple, simhash.near_components(df).collect()), key=repr)
    same, other = plain_fingerprint(rows[3][1]), plain_fingerprint(rows[6][1])
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    assert got == sorted([(None, 0, 3), (4, 0, 3), (3, 0, 3), (7, signed(same), 5), (7, signed(same), 5), (5, signed(same), 5), (None, signed(other), None)], key=repr)
    assert simhash.near_components(df.limit(0)).collect() == []


# ---- 12


def plain_repair(rows, costs, inserts=2):
    """Least (cost, audit) over all edits, with up to ``inserts`` inserted turns in each gap."""
    best = None
    gaps = [x for k in range(inserts + 1) for x in itertools.product("ua", repeat=k)]
    for edits in itertools.product(*(["D"] + ([] if must else ["K", "Ru", "Ra"]) for _, must, _ in rows)):
        base = sum(costs.delete if e == "D" else (costs.rerole if e[0] == "R" else 0) + costs.truncated * cut for e, (_, _, cut) in zip(edits, rows))
        for filled in itertools.product(gaps, repeat=len(rows) + 1):
            roles, audit = "", ""
            for k in range(len(rows) + 1):
                roles, audit = roles + "".join(filled[k]), audit + "I" * len(filled[k])
                if k < len(rows):
                    audit += edits[k][0]
                    roles += "" if edits[k] == "D" else edits[k][1] if edits[k][0] == "R" else rows[k][0] or "?"
            body = roles.removeprefix("s")
            if body == "ua" * (len(body) // 2) and (body or not roles):
                found = (base + costs.insert * sum(map(len, filled)), audit)
                best = found if best is None or found < best else best
    return best


@pytest.mark.parametrize("costs", [repair.Costs(), repair.Costs(insert=1), repair.Costs(2, 3, 2, 1), repair.Costs(1, 1, 1, 0)])
def test_op12_cheapest_equals_all_edits(costs):
    rng = random.Random(11)
    for _ in range(40):
        rows = [(rng.choice("ssuuaax"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 3))]
        assert repair.cheapest(rows, costs) == plain_repair(rows, costs), rows
    for _ in range(6):
        rows = [(rng.choice("suuaa"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(5)]
        assert repair.cheapest(rows, costs) == plain_repair(rows, costs, 1 if costs.insert < 5 else 0), rows


def test_op12_blocks_decide_alike():
    rng = random.Random(12)
    for n in (0, 1, 7, 8, 9, 40, 65):
        for _ in range(10):
            rows = [(rng.choice("suuaa"), rng.random() < 0.2, rng.random() < 0.2) for _ in range(n)]
            assert repair.cheapest(rows, block=8) == repair.cheapest(rows, block=10_000)
    cost, audit = repair.cheapest([("u" if k % 3 else "a", False, False) for k in range(100_000)])
    assert len(audit) == 100_000 and cost > 0


def plain_op12(rows):
    """Rows (conv_id, turn, role, text): conv_id -> counts, audit and digest, from the contract in plain Python."""
    out, convs = {}, {}
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        own = convs.setdefault(c, [])
        if fault == 1:
            text = ""
        if fault == 2:
            text = "".join(x for x in text if x not in ".!?")
        if fault == 4:
            role = "user"
        own += [(t, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    for c, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns, seen, found = [t for t, _, _ in own if t is not None], set(), []
        for _, role, text in own:
            body = text.strip(" \t\n\x0b\x0c\r")
            found.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
            seen.add((role, text))
        if len(own) <= 6:
            cost, audit = plain_repair([(r[:1], f in ("blank", "duplicate"), f == "truncated") for (_, r, _), f in zip(own, found)], repair.Costs(), 0)
        else:
            cost, audit = repair.cheapest([(r[:1], f in ("blank", "duplicate"), f == "truncated") for (_, r, _), f in zip(own, found)])
        kept, left = [], 0
        for (_, role, text), letter in zip(own, audit):
            if letter != "D":
                first = letter == "K" and role[:1] == "s"
                kept.append(f"{role if letter == 'K' else ('user', 'assistant')[left % 2]}:{text}")
                left += not first
        initials = [r[:1] for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        counts = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost)
        out[c] = (*counts, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def test_op12_equals_plain_python(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.op12_structure_repair(spark, SF_DIR).collect()}
    assert got == plain_op12(rows)


def test_op12_odd_rows(spark, tmp_path):
    rows = [
        (None, 1, "user", "hi."), (None, 2, "assistant", "yes."), (1, None, "user", "a."), (1, None, "user", "a."), (1, 3, None, None), (1, 9, "assistant", "b" * 200_000 + "!"),
        (2, 5, "tool", "x?"), (2, 5, "tool", "x?"), (2, 6, "", "é!"), (3, None, None, None), (4, -3, "system", "s."), (4, 2**40, "user", "u.\x0b"),
    ]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, present int, messages string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.op12_structure_repair(spark, str(tmp_path)).collect()}
    assert got == plain_op12(rows)
    assert repair.repair(df.limit(0)).collect() == []
    dropped = repair.repair(df.filter("conv_id = 1"), present=repair.F.lit(None).cast("boolean")).collect()
    assert [tuple(r) for r in dropped] == [(1, 0, 0, 0, 0, 0, 0, "", [])]


# ---- 13


def plain_codes(rows, entries=64, rounds=2, parts=16):
    """Rows (id, vector, label): (id, code, error, label) and the codebooks, in plain Python."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    whole = [[math.floor(Fraction(x) * 256) for x in map(float, v)] for _, v, _ in rows]
    cut = [[w[p * len(w) // parts : (p + 1) * len(w) // parts] for p in range(parts)] for w in whole]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            books[p] = [[sum(x) // len(groups[k]) for x in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])]
    out = []
    for (i, _, label), c in zip(rows, cut):
        found = [nearest(c[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def test_op13_equals_plain_python(spark, tmp_path):
    """Nulls, odd numbers, repeated ids and vectors, ties, clusters and a null label."""
    rng = np.random.default_rng(7)
    centers = rng.normal(size=(6, 32))
    vectors = [[float(np.float32(x)) for x in (centers[rng.integers(6)] + rng.normal(size=32) * rng.choice([0.01, 0.5]))] for _ in range(400)]
    vectors[200:300] = vectors[:100]
    rows = [(int(i), v, None if i % 7 == 0 else int(i % 3)) for i, v in enumerate(vectors)]
    rows += [(5, vectors[0], 1), (5, vectors[9], 1), (900, None, 1), (901, [None] + vectors[0][1:], 1), (902, [float("nan")] + vectors[0][1:], 1), (903, [float("-inf")] + vectors[0][1:], 1), (-4, [0.0] * 32, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, code string").repartition(5)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    want, digest = plain_codes(rows)
    totals = {}
    for _, _, e, label in want:
        totals[label] = totals.get(label, 0) + e
    got = sorted(tuple(r) for r in vector_codes.op13_vector_codes(spark, str(tmp_path)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())
    assert got == sorted((i, c, e, totals[label], digest) for i, c, e, label in want)


@pytest.mark.parametrize("width,scale", [(16, 1.0), (48, 1e30), (20, 1e12), (64, 3.0)])
def test_op13_sizes_of_numbers(spark, width, scale):
    rng = np.random.default_rng(width)
    rows = [(int(i), [float(x) for x in rng.normal(size=width) * scale], 0) for i in range(90)]
    coded, book = vector_codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    padded = [(i, v + [0.0] * (-width % 16), label) for i, v, label in rows]
    want, digest = plain_codes(padded)
    assert vector_codes.book_digest(book) == digest
    assert sorted(tuple(r) for r in coded.select("id", "code", "error").collect()) == sorted((i, c, min(e, 2**63 - 1)) for i, c, e, _ in want)


def test_op13_few_or_no_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    coded, book = vector_codes.compress(empty)
    assert vector_codes.label_errors(coded).collect() == [] and book.size == 0
    one, book = vector_codes.compress(spark.createDataFrame([(3, [1.0] * 16, None), (None, [1.0] * 16, None), (4, [1.0] * 15, None)], "vec_id long, embedding array<float>, label int"))
    assert sorted(map(tuple, vector_codes.label_errors(one).select("id", "code", "error", "label_error").collect()), key=repr) == [(3, "00" * 16, 0, 0), (None, "00" * 16, 0, 0)]
    assert book.shape == (16, 2, 1)


def test_op13_trees_cover_their_points():
    rng = np.random.default_rng(1)
    parts = rng.integers(-300, 300, (16, 700, 4))
    trees = vector_codes.cover_trees(parts)
    assert sorted(trees.order.tolist()) == sorted(list(range(700)) * 16)
    for k in range(len(trees.part)):
        own = trees.points[trees.start[k] : trees.end[k]]
        assert (own.sum(0) == trees.total[k]).all() and (own[0] == trees.center[k]).all()
        assert np.sqrt(((own - own[0]) ** 2).sum(1)).max() <= trees.radius[k] + 1e-9
        kids = range(trees.child[k], trees.child[k] + trees.children[k])
        assert sum(trees.end[c] - trees.start[c] for c in kids) in (0, len(own))
    book = rng.integers(-300, 300, (16, 64, 4))
    seen = np.zeros(16 * 700, int)
    whole = 0
    for part, entry, a, b in vector_codes.assigned(trees, book):
        for p, e, i, j in zip(part, entry, a, b):
            seen[i:j] += 1
            whole += j - i > 1
            assert (((trees.points[i:j, None] - book[p]) ** 2).sum(-1).argmin(1) == e).all()
    assert (seen == 1).all() and whole > 0
