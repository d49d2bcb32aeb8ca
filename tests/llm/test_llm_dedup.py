"""Deduplication, decontamination and fingerprints against plain versions."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from codequarry.llm import components as components_module, decontaminate, fingerprint, near, suffix
from codequarry.llm.components import components
from codequarry.llm.queries import op2_decontamination, op3_suffix_dedup, op8_fingerprint

from .brute import edit_infix, near_components, repeats

SF = "/root/testdata/sf0.001"


def texts(seed, n=60):
    """Texts of few words with copies, edits and shared passages, some odd ones among them."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    passage = " ".join(rng.choice(words) for _ in range(25))
    out = []
    for i in range(n):
        own = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        if out and rng.random() < 0.4:
            own = out[rng.randrange(len(out))][1].split()
            for _ in range(rng.randint(0, 3)):
                if own:
                    own[rng.randrange(len(own))] = rng.choice(words)
        said = " ".join(own)
        if rng.random() < 0.3:
            said += " " + passage
        out.append((i * 3, said))
    return out + [(1000, None), (1001, ""), (1002, "  \n\t "), (1003, "É" * 80), (1004, "É" * 80), (1005, "Un deux"), (1006, "un DEUX")]


def frame(spark, rows):
    """With further columns, one of them called like a result."""
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, kept string, component_id int")


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("words,small", [(4, 16), (3, 2)])
def test_near_duplicates(spark, monkeypatch, seed, words, small):
    # Small buckets of two at most put everything else through pivots and blocks.
    monkeypatch.setattr(near, "SMALL_BUCKET", small)
    rows = texts(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in
           near.near_duplicates(frame(spark, rows), words=words).collect()}
    want = near_components(rows, words, 80)
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}


def test_near_duplicates_of_a_large_group(spark, monkeypatch):
    """Copies of one text that are often too far from each other: all links count."""
    monkeypatch.setattr(near, "SMALL_BUCKET", 4)
    monkeypatch.setattr(near, "BLOCK_SHINGLES", 500)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(120):
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(30)}"
        rows.append((i, " ".join(own)))
    got = {r["doc_id"]: r["component_id"] for r in near.near_duplicates(frame(spark, rows), words=4).collect()}
    assert got == {i: c for i, (_, c) in near_components(rows, 4, 80).items()}


def test_near_duplicates_of_odd_tables(spark):
    assert near.near_duplicates(frame(spark, []), words=4).count() == 0
    rows = [(None, "a b c d e"), (None, None), (2, "a b c d e"), (2, "a b c d e"), (7, "a b c d e")]
    got = sorted(map(str, near.near_duplicates(frame(spark, rows), words=4).collect()))
    assert len(got) == 5
    assert sum("component_id=2" in g for g in got) == 3
    assert sum("component_id=None, kept=True" in g for g in got) == 2


def test_rows_of_one_id_link_by_each_of_their_texts(spark):
    """Copies of either text of an id belong to its group, and neither text is lost."""
    a = " ".join(f"a{i}" for i in range(60))
    b = " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (5, "c d e f g h"), (4, "c d e f g h"), (5, a + " z z2"), (9, "alone in here it is now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in near.near_duplicates(docs).collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (1, False), 4: (1, False), 5: (1, False), 9: (9, True)}
    assert near.near_duplicates(docs).count() == len(rows)


def test_all_links_of_similar_sets_are_found(spark):
    """Edited copies around the threshold, with repeated ids: recall against all pairs is whole."""
    random.seed(12)
    rows = []
    for g in range(40):
        words = [f"g{g}w{i}" for i in range(random.randrange(30, 120))]
        for _ in range(5):
            copy = list(words)
            for _ in range(random.randrange(0, max(2, len(words) // 40))):
                copy[random.randrange(len(copy))] = f"n{random.random()}"
            rows.append((random.randrange(150), " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [(d, {tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)}) for d, t in rows]
    low = {d: d for d, _ in rows}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for i, (d, s) in enumerate(sets):
        for e, r in sets[:i]:
            if 100 * len(s & r) >= 80 * len(s | r):
                x, y = sorted((find(d), find(e)))
                low[y] = x
    got = {r["doc_id"]: r["component_id"] for r in near.near_duplicates(docs).collect()}
    assert got == {d: find(d) for d, _ in rows}


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (9, 8), (8, 7), (5, 5)] + [(i, i + 1) for i in range(20, 60)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7} | {i: 20 for i in range(20, 61)}


def _plain_components(edges):
    """Every node with the smallest of its component."""
    named = {n: n for e in edges for n in e if e[0] != e[1]}
    while True:
        before = dict(named)
        for a, b in edges:
            if a != b:
                named[a] = named[b] = min(named[a], named[b])
        if named == before:
            return named


@pytest.mark.parametrize("lot", [1 << 19, 10])
def test_components_store_few_steps(spark, monkeypatch, lot):
    """Edges of one lot are two stored steps, however wide a component is; more go through stars."""
    steps, kept = [], components_module.cut

    def cut(df):
        steps.append(1)
        return kept(df)

    monkeypatch.setattr(components_module, "cut", cut)
    monkeypatch.setattr(components_module, "cut_counted", lambda df: (kept_step := cut(df), kept_step.count()))
    monkeypatch.setattr(components_module, "LOT_EDGES", lot)
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i + 1, i) for i in range(1000, 1300)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == _plain_components(edges)
    assert lot == 10 or len(steps) == 2


def test_edges_are_contracted_lot_by_lot(monkeypatch):
    monkeypatch.setattr(components_module, "LOT_EDGES", 16)
    rng = random.Random(6)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(100)]
    edges = [(max(e), min(e)) for e in edges if e[0] != e[1]]
    batches = [pa.RecordBatch.from_pydict({"a": [a for a, _ in part], "b": [b for _, b in part]}) for part in (edges[:5], edges[5:75], edges[75:])]
    lots = [list(zip(*lot.to_pydict().values())) for lot in components_module._contract(iter(batches))]
    assert len(lots) == -(-len(edges) // 16)
    assert _plain_components([e for lot in lots for e in lot]) == _plain_components(edges)
    assert list(components_module._contract(iter([]))) == []


def digest(rows):
    return {r["doc_id"]: (bytes(r["sa_kept"]), r["sa_removed"], r["sa_spans"]) for r in rows}


@pytest.mark.parametrize("seed,common", [(1, None), (2, None), (3, -1.0)])
def test_suffix_dedup(spark, monkeypatch, seed, common):
    if common is not None:  # every anchor counts as common
        monkeypatch.setattr(suffix, "COMMON", common)
        monkeypatch.setattr(suffix, "COMMON_SHARE", 1)
    monkeypatch.setattr(suffix, "GROUP_BYTES", 2000)
    monkeypatch.setattr(suffix, "BUCKET_BYTES", 1500)
    rows = texts(seed)
    got = suffix.remove_repeats(frame(spark, rows), window=50).collect()
    assert {r["kept"] for r in got} == {"x"}
    assert digest(got) == repeats(rows, 50)


def test_suffix_dedup_of_odd_tables(spark):
    assert suffix.remove_repeats(frame(spark, [])).count() == 0
    long = "abcdefghij" * 30
    rows = [(None, long), (4, long), (4, long), (4, long + "!"), (6, long), (5, "short")]
    got = [(r["doc_id"], r["sa_removed"]) for r in suffix.remove_repeats(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(None, 0), (4, 0), (4, 0), (4, 0), (6, 300), (5, 0)], key=str)


@pytest.mark.parametrize("as_text", [False, True])
def test_suffix_dedup_leaves_rows_without_id_alone(spark, as_text):
    """Many rows without id: whole, in no group, and without effect on others."""
    long = "Zeile für Zeile " * 12
    rows = [(None, long, "x")] * 300 + [(None, None, "x"), (None, "", "x"), (8, long, "x"), (9, long, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sa string")
    got = suffix.remove_repeats(docs, as_text=as_text)
    whole = long if as_text else long.encode()
    empty = whole[:0]
    n = len(long.encode())
    want = [(None, n, 0, 0, whole)] * 300 + [(None, 0, 0, 0, empty)] * 2 + [(8, n, 0, 0, whole), (9, n, n, 1, empty)]
    found = [(r["doc_id"], r["sa_bytes"], r["sa_removed"], r["sa_spans"], r["sa_kept"] if as_text else bytes(r["sa_kept"])) for r in got.collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert suffix.remove_repeats(docs.where("doc_id is null"), as_text=as_text).count() == 302


def test_suffix_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["kept_sha256"], r["n_removed"], r["n_spans"]) for r in op3_suffix_dedup(spark, SF).collect()}
    assert got == {i: (hashlib.sha256(k).hexdigest(), n, s) for i, (k, n, s) in repeats(docs, 50).items()}


def test_index_family_keeps_levels_geometric():
    rng = np.random.default_rng(3)
    family, seen = suffix.IndexFamily(), {}
    for batch in range(9):
        windows = rng.integers(0, 4000, 300).astype(np.uint64)
        doc = batch * 100 + rng.integers(0, 100, 300)
        low = {}
        for w, d in zip(windows.tolist(), doc.tolist()):
            low[w] = min(low.get(w, d), d)
        want = [min(seen.get(w, d), low[w]) < d for w, d in zip(windows.tolist(), doc.tolist())]
        assert family.add(windows, doc).tolist() == want
        for w, d in low.items():
            seen[w] = min(seen.get(w, d), d)
        sizes = [len(level.suffix) for level in family.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))
        assert all((np.diff(level.suffix.astype(float)) > 0).all() for level in family.levels)


def test_infix_distance():
    rng = random.Random(4)
    for _ in range(200):
        p = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 25)))
        s = "".join(rng.choice("ab ") for _ in range(rng.randint(0, 50)))
        got, _ = decontaminate.infix_distance(decontaminate.masks_of(p), len(p), s, len(p) - 1)
        assert got == min(edit_infix(p, s), len(p))


def test_decontamination_against_all_alignments(spark):
    rng = random.Random(6)
    item = lambda n: " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(2, 7))) for _ in range(n))
    items = [(i, item(rng.randint(3, 12))) for i in range(8)] + [(8, None), (9, ""), (10, "!!"), (3, "Twice Told, tales")]
    docs = []
    for i in range(60):
        said = list(rng.choice(items[:8])[1])
        for _ in range(rng.randint(0, 8)):
            k = rng.randrange(len(said))
            said[k:k + rng.randint(0, 1)] = rng.choice(["", "a", "b", "X"])
        docs.append((i, f"{item(6)} {''.join(said).upper() if i % 3 else ''.join(said)} {item(5)}"))
    docs += [(100, None), (101, ""), (102, "twice -- TOLD\n tales"), (102, "twice -- TOLD\n tales")]
    got = decontaminate.matches(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    for r in got:
        body = decontaminate.folded(r["text"] or "")
        want = {}
        for i, said in items:
            f = decontaminate.folded(said or "")
            if f and body and (d := edit_infix(f, body)) <= int(decontaminate.RATE * len(f)):
                want.setdefault(i, []).append(d)
        assert {i: sorted(d) for i, d in want.items()} == {
            m["item_id"]: sorted(x["distance"] for x in r["matches"] if x["item_id"] == m["item_id"]) for m in r["matches"]}
        for m in r["matches"]:
            f = {decontaminate.folded(s) for i, s in items if i == m["item_id"]}
            part = decontaminate.folded(r["text"][m["start"]:m["end"]])
            assert any(decontaminate_distance(x, part) == m["distance"] for x in f)
    none = decontaminate.matches(frame(spark, docs), spark.createDataFrame([], "item_id long, text string"))
    assert {len(r["matches"]) for r in none.collect()} == {0}


def decontaminate_distance(a, b):
    return fingerprint.edit_distance(a, b)


def test_places_follow_what_is_compared():
    """Letters whose lower case is longer, or depends on the end of the word."""
    from codequarry.llm import decontaminate

    for said in ("Aİ b the quick", "ΑΣ ΑΣΑ x", "İİ_İ 1", "", "ß ẞ ŉ"):
        assert len(decontaminate.folded(said)) == len(decontaminate.places(said))
    spots = decontaminate.places("Aİ b")
    assert [spots[decontaminate.folded("Aİ b").index("b")]] == [(3, 4)]


def test_decontamination_query_finds_planted_items(spark):
    items = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    want = {(d, i) for d, t in docs.items() for i, s in items.items() if s in t}
    got = {(r["doc_id"], r["item_id"]) for r in op2_decontamination(spark, SF).collect()}
    assert want and want <= got


def test_fingerprints_follow_edits():
    rng = random.Random(7)
    one = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    two = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    slight = one[:1500] + "xyz" + one[1500:]
    a, b, c, d, empty = fingerprint.fingerprints([one, slight, two, one, ""])
    assert a == d and fingerprint.likeness(a, b) > 0.6 > 0.1 > fingerprint.likeness(a, c)
    assert empty == bytes(fingerprint.SLOTS) and fingerprint.likeness(empty, empty) == 1.0


def test_fingerprints_do_not_depend_on_company():
    rng = random.Random(8)
    many = ["".join(rng.choice("abc é") for _ in range(rng.randint(1, 400))) for _ in range(200)]
    together = fingerprint.fingerprints(many)
    assert together == [fingerprint.fingerprints([t])[0] for t in many]


def test_edit_distance():
    rng = random.Random(9)
    for _ in range(100):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 12))) for _ in range(2))
        table = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(table[j] + 1, row[-1] + 1, table[j - 1] + (x != y)))
            table = row
        assert fingerprint.edit_distance(a, b) == table[-1]


def test_fingerprint_query(spark):
    got = {r["doc_id"]: r for r in op8_fingerprint(spark, SF).collect()}
    docs = sorted((r[0], r[1] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    assert len(got) == len(docs)
    for k, (i, said) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        half = len(said) // 2
        edited = said[:len(said) - half] + after[:half]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(said), hashlib.sha256(edited.encode()).hexdigest())
        assert got[i]["fingerprint"] == fingerprint.fingerprints([said])[0].hex()
        assert 0 <= got[i]["near_next"] <= 1 and 0 <= got[i]["near_edited"] <= 1


def test_neighbours_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_BYTES", 300)
    monkeypatch.setattr(fingerprint, "CHUNK", 500)
    rows = [(i * 7, f"text number {i} " * (i % 5)) for i in range(80)] + [(7, "again"), (7, "again"), (None, "none"), (900, None)]
    got = fingerprint.with_neighbour(frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["n_chars"]) for r in got if r["doc_id"] is not None) == sorted((i, len(t or "")) for i, t in rows if i is not None)
    last = next(r for r in got if r["doc_id"] == 900)
    assert last["edited_sha256"] == hashlib.sha256(b"").hexdigest()
    assert fingerprint.with_neighbour(frame(spark, [])).count() == 0
    one = fingerprint.with_neighbour(frame(spark, [(5, "abcd")])).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one[0]["near_next"] == 1.0


def test_near_pairs(spark):
    rng = random.Random(10)
    base = "".join(rng.choice("abcdefgh ") for _ in range(2000))
    other = "".join(rng.choice("abcdefgh ") for _ in range(2000))
    rows = [(1, base), (2, base), (3, base[:1900] + "zz" + base[1900:]), (4, other), (5, None)]
    got = {(r["doc_id"], r["other_id"]) for r in fingerprint.near_pairs(frame(spark, rows), least=0.7).collect()}
    assert got == {(2, 1), (3, 1)}


@pytest.mark.parametrize("small", [16, 100])
def test_near_pairs_of_a_large_group(spark, monkeypatch, small):
    # Copies are like their original, which has the largest id, but not like each other.
    monkeypatch.setattr(fingerprint, "SMALL_BUCKET", small)
    monkeypatch.setattr(fingerprint, "BLOCK", 7)
    rng = random.Random(11)

    def text(n=1500):
        return "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))

    def edited(said, n=14):
        for _ in range(n):
            at = rng.randrange(len(said))
            said = said[:at] + rng.choice("qrstuv") + said[at + 1:]
        return said

    first, second = text(), text()
    rows = [(i, edited(first)) for i in range(60)] + [(i, edited(second, 8)) for i in range(60, 70)]
    rows += [(70 + i, text()) for i in range(10)] + [(1000, first), (1001, second), (1002, second), (1003, None), (1004, "")]
    marks = fingerprint.fingerprints([t or "" for _, t in rows])
    alike = {(a[0], b[0]): fingerprint.likeness(x, y) for b, y in zip(rows, marks) for a, x in zip(rows, marks) if a[0] > b[0]}
    alike = {p: s for p, s in alike.items() if s >= 0.8}
    assert sum(a == 1000 for a, _ in alike) > 20
    said = dict(rows)
    few = {p for p in alike if fingerprint.edit_distance(said[p[0]] or "", said[p[1]] or "") <= 0.008 * 1500}

    def groups(pairs):
        low = {i: i for i, _ in rows}
        for _ in rows:
            for a, b in pairs:
                low[a] = low[b] = min(low[a], low[b])
        return low

    got = {(r["doc_id"], r["other_id"]): r["likeness"] for r in fingerprint.near_pairs(frame(spark, rows)).collect()}
    assert got.items() <= alike.items() and groups(got) == groups(alike)
    if small == 100:
        assert {p for p in alike if 1002 not in p} == {p for p in got if 1002 not in p}
    got = {(r["doc_id"], r["other_id"]) for r in fingerprint.near_pairs(frame(spark, rows), most_edits=0.008).collect()}
    assert got <= few and len(few) < len(alike) and groups(got) == groups(few)
