"""License scans, Merkle manifest and filter audit against brute force, SQL and odd tables."""

import hashlib
import os
import random
import re
import zlib
from itertools import permutations

import duckdb
import numpy as np
import pytest

from tonequarry.llm import interaction, licenses, merkle, queries

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, idx long, at long, `__slot` long, mask int"


def docs_of(spark, rows):
    """Documents of (doc_id, text, lang, source) with more columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t), "x", 1, 2, 3, 4) for i, t, g, s in rows], DOCS)


def rows_of(columns, rows):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(r[i] for i in at) for r in rows), key=str)


@needs_tables
@pytest.mark.parametrize("name", ["op11_licenses", "op12_manifest", "op13_interaction"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    theirs = con.sql(queries.oracle_sql()[name])
    mine = queries.queries()[name](spark, SF)
    assert rows_of(mine.columns, mine.collect()) == rows_of(theirs.columns, theirs.fetchall())


# 11 ---------------------------------------------------------------------------------------------------------------


def blocks_by_force(text, templates):
    """Every (template, start) whose block holds enough of the template, with what it shares."""
    ws = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    out = {}
    for i, t in enumerate(templates):
        own = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.text.encode()))
        for s in range(len(ws)):
            shared = len(set(own) & set(ws[s : s + -(-len(own) * 5 // 4)]))
            if 5 * shared >= 4 * len(set(own)):
                out[i, s] = shared
    return ws, out


def planted_licenses():
    r = random.Random(5)
    filler = "of the in a license under this work copy version is to and software 2 3".split()
    texts = [None, "", " .,; ", "CC BY", "cc-by cc/BY cc.by", "All rights reserved. ALL RIGHTS, reserved", "É License MIT the", "the MIT\nlicense"]
    for t in licenses.TEMPLATES:
        ws = t.text.split()
        for lost in (0, len(ws) // 10, len(ws) // 5, len(ws) // 3):
            own = ws[:]
            for _ in range(lost):
                own[r.randrange(len(own))] = r.choice(["zzz", *filler])
            texts.append(" ".join([*r.choices(filler, k=r.randrange(60)), *own, *r.choices(filler, k=r.randrange(60))]))
    return texts + [" ".join(r.choices(filler + licenses.TEMPLATES[8].text.split(), k=300)) for _ in range(20)]


def test_licenses_against_force(spark):
    texts = planted_licenses()
    rows = licenses.scan(docs_of(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()
    assert len(rows) == len(texts)
    some = 0
    for row in rows:
        ws, want = blocks_by_force(texts[row.doc_id] or "", licenses.TEMPLATES)
        assert row.n_words == len(ws)
        best = {}
        for (i, _), n in want.items():
            best[i] = max(best.get(i, 0), n)
        got = {}
        for b in row.blocks:
            got[b.template] = max(got.get(b.template, 0), b.shared)
            own = set(licenses.words(licenses.TEMPLATES[b.template].text))
            assert ws[b.start] in own and ws[b.end - 1] in own
            most = -(-len(licenses.words(licenses.TEMPLATES[b.template].text)) * 5 // 4)
            assert any((b.template, s) in want for s in range(max(0, b.start - most + 1), b.start + 1))
        assert got == best, row.doc_id
        # No two blocks of a template touch, and each start that matches is inside one.
        for i, s in want:
            hits = [p for p in range(s, len(ws)) if ws[p] in set(licenses.words(licenses.TEMPLATES[i].text))]
            assert any(b.template == i and b.start <= hits[0] < b.end for b in row.blocks)
        some += len(want)
    assert some > 100


def test_license_words_in_steps(monkeypatch):
    text = planted_licenses()[-1] * 3 + "É" * 50 + "x" * 9000 + " tail"
    whole = licenses.words(text)
    for step in (1, 7, 100):
        monkeypatch.setattr(licenses, "STEP", step)
        assert licenses.words(text) == whole


def test_license_report(spark):
    texts = ["Licensed under CC BY-NC 4.0.", "all rights reserved, GNU General Public License", "released under the mit license", "nothing here", None]
    docs = docs_of(spark, [(i, t, None, None) for i, t in enumerate(texts)] + [(None, "cc by", "en", "s")] * 2)
    rows = licenses.report(licenses.scan(docs)).collect()
    assert len(rows) == 7 and sum(r.doc_id is None for r in rows) == 2
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in rows}
    assert got[0] == (7, 1, 2, 2, "cc-by", "cc-by,cc-by-nc", 1.0)
    assert got[1] == (7, 2, 0, 4, "gpl,reserved", "gpl,reserved", 1.0)
    assert got[2] == (5, 0, None, None, "", "mit", 1.0)
    assert got[3] == (2, 0, None, None, "", "", 0.0) and got[4] == (0, 0, None, None, "", "", 0.0)
    assert licenses.report(licenses.scan(docs.limit(0))).collect() == []


# 12 ---------------------------------------------------------------------------------------------------------------


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(i, source, lang, n, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def tree(hashes):
    """The root, and the siblings of each leaf as (left, right) level by level."""
    sides, at, level = [[] for _ in hashes], list(range(len(hashes))), hashes
    while len(level) > 1:
        for k, a in enumerate(at):
            run = level[a // 8 * 8 : a // 8 * 8 + 8]
            sides[k].append(("".join(run[: a % 8]), "".join(run[a % 8 + 1 :])))
        level = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
        at = [a // 8 for a in at]
    return level[0], sides


def manifest_by_force(rows):
    full = sorted(((i, leaf(i, s, g, None if t is None else len(t), t), t, g, s) for i, t, g, s in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    parts = {}
    for r in full:
        parts.setdefault(r[3], []).append(r)
    names = sorted(parts, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([r[1] for r in parts[g]]) for g in names}
    root, above = tree([trees[g][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for r, sides in zip(parts[g], trees[g][1], strict=True):
            f = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[2] is not None:
                low = re.sub("[A-Z]", lambda m: m[0].lower(), r[2])
                f = leaf(r[0], r[4], g, len(r[2]), low)
            for a, b in (*sides, *above[k]):
                f = sha(a + f + b)
            out.append((r[0], r[1], trees[g][0], root, sha("".join(a + b for a, b in (*sides, *above[k]))), f, f == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_manifest_against_force(spark, depth):
    r = random.Random(depth)
    rows = [(i, r.choice(["Abc É", "abc é", "", None, f"T{i}"]), lang, r.choice(["s", None])) for i, lang in enumerate(["en"] * 150 + ["de"] * 64 + ["fr"] * 65 + [None] * 9 + ["é", "z"])]
    rows += [(None, "Null id", "en", "s"), (5, "Abc", "en", "s"), (5, "Abc", "en", "s"), (5, "abd", "en", "s")]
    got = merkle.manifest(docs_of(spark, rows), tampered=True, depth=depth).collect()
    assert sorted((tuple(x) for x in got), key=str) == manifest_by_force(rows)


def test_manifest_of_small_tables(spark):
    assert merkle.manifest(docs_of(spark, [])).collect() == []
    one = [(7, "A text", None, None)]
    got = merkle.manifest(docs_of(spark, one)).collect()[0]
    assert got.leaf == got.subroot == got.root == got.folded_root and got.verified and got.proof_sha256 == sha("")
    same = [(1, "x", "en", "s")] * 30
    assert sorted((tuple(x) for x in merkle.manifest(docs_of(spark, same), tampered=True).collect()), key=str) == manifest_by_force(same)
    assert len({x.proof_sha256 for x in merkle.manifest(docs_of(spark, [(i, "w " * 50_000, "en", "s") for i in range(3)])).collect()}) == 3


# 13 ---------------------------------------------------------------------------------------------------------------


def masks_by_force(rows):
    least = {}
    for i, t, _, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    out = []
    for i, t, _, s in rows:
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = (len(ws) < 50, 100 * len(set(ws)) < 65 * len(ws), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > least[t])
        out.append((i, s or "", {x for x, f in zip("ABCDE", fails, strict=True) if f}))
    return out


def audit_by_force(rows, labels):
    out = {}
    shapley = {}
    for order in map("".join, permutations("ABCDE")):
        for i, part, fails in masks_by_force(rows):
            gone = next((k for k, f in enumerate(order) if f in fails), 5)
            for k, f in enumerate(order):
                v = out.setdefault((part, order, k + 1), np.zeros(6, int))
                v += [gone > k, gone == k, f in fails and gone < k, fails == {f}, gone == k and (i, "q") in labels, gone == k and (i, "t") in labels]
                shapley[part, f] = shapley.get((part, f), 0) + (gone == k)
    return {k: (*v.tolist(), shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_rows():
    r = random.Random(3)
    long = " ".join(f"w{i}" for i in range(60))
    pool = [None, "", "a", long, long + " #", "W " * 60, long.upper(), "same " * 80, "same " * 80 + "$", "é " * 70, "\x1c".join(["w"] * 60), " ".join(["w"] * 60)]
    rows = [(i, r.choice(pool) if i % 3 else long, "en", r.choice(["s0", "s1", None])) for i in range(150)]
    return rows + [(None, long, "en", "s0"), (None, "a", "en", None), (4, long, "en", "s1"), (4, long, "en", "s2"), (3, "a", "en", "s1")]


def test_audit_against_force(spark):
    rows = audit_rows()
    said = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 150, 2)] + [(3, None, 1), (3, 1, None), (None, 1, 1), (999, 1, 1)]
    labels = spark.createDataFrame(said, "doc_id long, quality int, toxic int")
    flags = {(i, "q") for i, q, _ in said if q == 1 and i is not None} | {(i, "t") for i, _, t in said if t == 1 and i is not None}
    got = interaction.audit(docs_of(spark, rows).repartition(5), labels).collect()
    assert len(got) == 4 * 600 and len(got[0]) == 10
    assert {(g.part, g.filter_order, g.step): tuple(g)[3:] for g in got} == audit_by_force(rows, flags)


def test_chains_tell_colliding_texts_apart(monkeypatch):
    """With one hash for all texts the chains alone keep them apart."""
    monkeypatch.setattr(interaction.xxhash, "xxh64_intdigest", lambda data: 7)
    rows = audit_rows()
    for held in (1, 1 << 24):
        monkeypatch.setattr(interaction, "HELD", held)
        routed = [p for k in range(0, len(rows), 20) for p in interaction.route([(i, s or "", (t or "").encode()) for i, t, _, s in rows[k : k + 20]])]
        got = sorted((str(i), part, mask) for i, part, mask, n in interaction.settle(routed) for _ in range(n))
        assert got == sorted((str(i), part, sum(1 << "ABCDE".index(f) for f in fails)) for i, part, fails in masks_by_force(rows))


def test_audit_of_odd_tables(spark, monkeypatch):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interaction.audit(docs_of(spark, []), none).collect() == []
    rows = interaction.audit(docs_of(spark, [(None, None, None, None)]), none).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {""} and {r.kept for r in rows if r.step == 5} == {0}
    text = " ".join(f"w{i % 40_000}" for i in range(100_000)).encode() + b" " + b"x" * 5000
    want = interaction.mask_of(text)
    for step in (100, 4096):
        monkeypatch.setattr(interaction, "STEP", step)
        assert interaction.mask_of(text) == want == 2
