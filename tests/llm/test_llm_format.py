"""Packing, chat formatting, page extraction and the pipeline."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import time

import pytest
from pyspark.sql import functions as F

from codequarry.llm import chat, html, packing
from codequarry.llm.queries import op6_packing, op7_chat, op10_html

SF = "/root/testdata/sf0.001"


# --- packing ----------------------------------------------------------------------------

@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_str(packing.tokenizer_source())


def check_packing(rows, docs, tokenizer, length):
    """Every id in exactly one piece, gapless sequences within bounds; returns the padding."""
    want = defaultdict(int)
    for doc, said in docs:
        ids = tokenizer.encode(said or "", add_special_tokens=False).ids + [packing.END_ID]
        want[(doc, len(ids))] += 1
        by = sorted((r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == doc and r["doc_tokens"] == len(ids))
        for start, size, crc in by:
            assert zlib.crc32(np.array(ids[start:start + size], "<u4").tobytes()) == crc
    tokens = defaultdict(int)
    for r in rows:
        tokens[(r["doc_id"], r["doc_tokens"])] += r["length"]
    assert dict(tokens) == {k: k[1] * n for k, n in want.items()}
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        assert at <= length
    return 1 - sum(r["length"] for r in rows) / (length * len(sequences))


def test_packing_query(spark, tokenizer):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert check_packing(op6_packing(spark, SF).collect(), docs, tokenizer, 4096) < 0.1


def test_packing_of_odd_rows(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "PART_ROWS", 3)
    docs = [(1, None), (2, ""), (3, "Same text, twice."), (3, "Same text, twice."), (4, "word's don't, I'll été... <|endoftext|> <|ENDOFTEXT|> a.b,c"),
            (5, "long " * 900), (6, "É́…, x y  z 12.5 a1b2 .,;: it's"), (7, " \n\t ")] + [(100 + i, "ab cd " * i) for i in range(40)]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, length string")
    rows = packing.pack(frame, packing.tokenizer_source(), length=128, grain=4).collect()
    assert check_packing(rows, docs, tokenizer, 128) < 0.1
    assert packing.pack(frame.where("false"), packing.tokenizer_source()).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plans_hold_the_histogram(seed):
    rng = np.random.default_rng(seed)
    histogram = {int(s): int(rng.integers(1, 400)) for s in rng.choice(np.arange(1, 65), 30, replace=False)}
    made = packing.plan(histogram, 64)
    held = defaultdict(int)
    for pattern, times in made:
        assert times > 0 and sum(s * c for s, c in pattern.items()) <= 64
        for s, c in pattern.items():
            held[s] += c * times
    assert dict(held) == histogram
    assert sum(t for _, t in made) <= least_sequences(histogram, 64) * 1.03 + 2


def least_sequences(histogram, capacity):
    """A bound that no packing can go below: large pieces share no sequence, and what small
    ones do not find room for beside them needs sequences of its own."""
    best = 0
    for small in range(capacity // 2 + 1):
        large = {s: c for s, c in histogram.items() if s > capacity - small}
        half = {s: c for s, c in histogram.items() if capacity // 2 < s <= capacity - small}
        rest = sum(s * c for s, c in histogram.items() if small <= s <= capacity // 2)
        room = sum((capacity - s) * c for s, c in half.items())
        best = max(best, sum(large.values()) + sum(half.values()) + max(0, -(-(rest - room) // capacity)))
    return best


@pytest.mark.parametrize("lengths", ["empty", "short", "mixed"])
def test_little_padding_of_short_texts(spark, tokenizer, lengths):
    """Only empty texts; one third empty and the rest of 5 to 60 tokens; those and some long ones."""
    n = {"empty": F.lit(0), "short": F.when(F.col("id") % 3 == 0, 0).otherwise(5 + F.col("id") % 56),
         "mixed": F.when(F.col("id") % 50 == 0, 2000 + F.col("id") % 900).otherwise(F.col("id") % 90)}[lengths]
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a "), n.cast("int")).alias("text"))
    got = packing.pack(docs, packing.tokenizer_source()).toPandas()
    used = got.groupby("sequence_id").length.sum()
    assert set(got.doc_id) == set(range(40_000)) and got.length.sum() == got.drop_duplicates("doc_id").doc_tokens.sum()
    assert used.max() <= 4096 and (got.groupby("sequence_id").offset.min() == 0).all()
    ordered = got.sort_values(["sequence_id", "offset"])
    end = (ordered.offset + ordered.length).shift(1)
    same = ordered.sequence_id == ordered.sequence_id.shift(1)
    assert (ordered.offset[same] == end[same]).all()
    assert 1 - got.length.sum() / (4096 * len(used)) < 0.05


def test_best_filling_is_best():
    rng = np.random.default_rng(1)
    size = np.array([3, 5, 7])
    for _ in range(20):
        value = rng.random(3)
        got, taken = packing.best_filling(value, size, 20)
        best = max(a * value[0] + b * value[1] + c * value[2] for a in range(7) for b in range(5) for c in range(3) if 3 * a + 5 * b + 7 * c <= 20)
        assert got == pytest.approx(best) and taken @ size <= 20 and taken @ value == pytest.approx(got)


# --- chat -------------------------------------------------------------------------------

HARD = ["", "a", " ", "\\", "\\\\#", "</turn>", "### user: x </turn>\n", "\\### Assistant: </turn> ok", "aa\nb: c", ": ", " </turn>\n### ", "\U0001f600"]


@pytest.mark.parametrize("said", HARD)
def test_escape_is_reversible(said):
    assert chat.unescape(chat.escape(said)) == said


def test_rendering_locates_turns():
    turns = [(role, said) for said in HARD for role in ("user", "assistant", "we: ird")]
    got = chat.render(chat.turn_template, turns)
    assert got.output == chat.turn_template(turns) and not got.rewrites
    assert "".join(got.output[a:b] for a, b in got.spans) == got.output
    for (role, said), (start, _), (a, b) in zip(turns, got.spans, got.texts):
        assert chat.unescape(got.output[a:b]) == said
        assert chat.role_of(got.output, start, a) == role


def test_rewriting_templates_are_told():
    def only_last_thought(turns):
        return "".join(f"<{r}>{s if k == len(turns) - 1 else s[:1]}" for k, (r, s) in enumerate(turns))

    assert chat.render(only_last_thought, [("user", "abc"), ("assistant", "def")]).rewrites
    assert not chat.render(lambda t: "BOS" + "".join(s for _, s in t), [("user", "abc"), ("assistant", "def")]).rewrites


def read(spark, rows):
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, output string")
    made = chat.format_conversations(frame)
    return made.withColumn("back", chat.read_back("output", "turns")).select("conv_id", "back.*", "rewrites").collect()


def digests(turns):
    everything = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(everything.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_conversations_of_odd_rows(spark):
    rows = [(1, 1, "assistant", None), (1, 0, None, "hi"), (1, 2, "assistant", HARD[7]), (1, 2, "assistant", HARD[7]), (None, 0, "user", "no id"),
            (2, None, "assistant", "no turn"), (2, 5, "user", "")] + [(3, k, "assistant", f"answer {k}") for k in range(300)]
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in read(spark, rows)}
    assert got[1] == digests([("", "hi"), ("assistant", ""), ("assistant", HARD[7]), ("assistant", HARD[7])])
    assert got[2] == digests([("assistant", "no turn"), ("user", "")])
    assert got[3] == digests([("assistant", f"answer {k}") for k in range(300)])
    assert got[None][0] == 1 and len(got) == 4
    assert read(spark, []) == []


def test_chat_query(spark):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns[r["conv_id"]].append((r["role"], r["text"] or ""))
    turns[-7] = [("user", HARD[7]), ("assistant", HARD[7])]
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in op7_chat(spark, SF).collect()}
    assert got == {i: digests(t) for i, t in turns.items()}


# --- pages ------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def forest(spark):
    return html.fit(spark.read.parquet(f"{SF}/pages.parquet"))


def test_page_query_gives_the_articles(spark):
    import html as references
    import re

    got = {r["page_id"]: r for r in op10_html(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    equal = 0
    for r in pages:
        body = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1]
        parts = [re.sub(r"<[^>]*(>|\Z)", "", p.replace("<br>", " ")) for p in re.split(r"</?(?:p|h1)>", body)]
        want = "\n".join(filter(None, (" ".join(references.unescape(p).split()) for p in parts)))
        equal += got[r["page_id"]]["text"] == want
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])
    assert equal >= 0.98 * len(pages)


def test_pages_without_an_article_tag(forest):
    page = (
        "<html><head><title>t</title><script>var a='<p>no</p>'</script></head><body><div class=menu><a href=1>Home</a> <a href=2>More</a></div>"
        "<div class=content><h1>The &amp; title</h1><p>First   paragraph of the text,\nwith <b>bold</b> words. It goes on, and on.</p>"
        "<div class='ad banner'>Buy now</div><p>Second paragraph, of which there is more to say. Indeed.</p></div>"
        "<div id=comments><div class=comment><p>Reader says hello, and more of it. Thanks.</p></div></div>"
        "<form><label>Mail</label><input></form><div class='cookie-notice'><p>We use cookies, and you accept.</p></div></body></html>")
    assert html.extract([page], forest) == [
        "The & title\nFirst paragraph of the text, with bold words. It goes on, and on.\n"
        "Second paragraph, of which there is more to say. Indeed."]


@pytest.mark.parametrize("many", [62, 63, 64, 500])
@pytest.mark.parametrize("early", [True, False])
def test_a_lone_element_among_many_siblings(many, early):
    said = [f"<p>Paragraph {i} says a little, and then more of it.</p>" for i in range(many)]
    at = 3 if early else many - 3
    said.insert(at, "<div>Buy one now</div>")
    nodes = html.parse("<section>" + "".join(said) + "</section>")
    rows, _ = html.features(nodes)
    below = rows[[i for i, n in enumerate(nodes) if n.parent == 1]]
    assert (below[:, 20] == many + 1).all()
    assert below[:, 21] == pytest.approx(np.arange(many + 1) / many)
    lone = np.arange(many + 1) == at
    assert below[:, 22] == pytest.approx(np.where(lone, 0, (many - 1) / many))


@pytest.mark.parametrize("page", [
    "<a " * 330_000, "<!" * 500_000, "<p>" * 150_000 + "</div>" * 100_000, "<div>" * 60_000 + "</span>" * 100_000, "<a \">\" " * 120_000,
    "<b>" * 60_000 + "<hr>" * 60_000, "<ul><li>" + "<div>" * 60_000 + "<li></li>" * 60_000, "<!-- " * 200_000, "<p><button>" + "<b>" * 50_000 + "<hr>" * 50_000,
])
def test_hostile_pages_are_parsed_in_one_walk(page):
    began = time.perf_counter()
    nodes = html.parse(page)
    assert time.perf_counter() - began < 20 and len(nodes) >= 1


def test_unfinished_and_careless_tags():
    def said(page):
        nodes = html.parse(page)
        return [n.tag for n in nodes[1:]], html.blocks(nodes, np.full(len(nodes), html.KEPT))

    assert said("<p>one <b two") == (["p"], ["one <b two"])
    assert said("<p title='a>b'>x</p>") == (["p"], ["x"])
    assert said("<p title=\"it's > 1\">x</p><i>y</i>") == (["p", "i"], ["x", "y"])
    assert said("<p a=\">\" <i b=\"x\">y") == (["p"], ["y"])
    assert said("<ul><li>a<li>b</ul><p>c<p>d<hr>e") == (["ul", "li", "li", "p", "p", "hr"], ["a", "b", "c", "d", "e"])
    assert said("1 < 2 </nothing> 3<br>4 <!doctype x> 5") == (["br"], ["1 < 2 3 4 5"])


def test_references_end_at_tags():
    def said(page):
        nodes = html.parse(page)
        return html.blocks(nodes, np.full(len(nodes), html.KEPT))

    assert said("<p>AT&<b>amp;</b> x &am<i>p;</i> &amp;lt; &#65;&nbsp;b</p>") == ["AT&amp; x &amp; &lt; A b"]


def test_inline_parts_of_a_kept_block_stay(forest):
    """A class alone takes no words out of a sentence; a script in it goes."""
    long = "It was a long day, and they went on with the work until the evening came. " * 6
    page = (f"<html><body><nav class='menu'><a href='/'>Home</a></nav><article><h1>Work</h1><p>{long}</p>"
            f"<p>End of it, really. <span class='tag'>note</span> done. <b class='ad'>So <i class='menu'>it</i></b> is.<script>x()</script></p>"
            f"<p>{long}</p></article><footer class='footer'>Imprint</footer></body></html>")
    nodes = html.parse(page)
    values, own = html.features(nodes)
    out = html.blocks(nodes, html.decode(nodes, forest.margin(values), own))
    assert "End of it, really. note done. So it is." in out and "Home" not in out and "Imprint" not in out


def test_decoding_never_contradicts(forest):
    rng = np.random.default_rng(4)
    for _ in range(50):
        nodes = [html.Node("#document", -1, 0, frozenset())]
        for i in range(1, 40):
            p = int(rng.integers(max(0, i - 6), i))
            nodes.append(html.Node("div", p, nodes[p].depth + 1, frozenset()))
            nodes[p].children.append(i)
        state = html.decode(nodes, rng.normal(size=40), rng.integers(0, 50, 40).astype(float))
        for i in range(1, 40):
            above = state[nodes[i].parent]
            assert above != html.DROPPED or state[i] == html.DROPPED
            assert above != html.KEPT or state[i] != html.MIXED


def test_odd_pages(spark, forest):
    rows = [(1, None), (2, ""), (3, "plain &lt; text"), (4, "<div>" * 3000 + "deep"), (5, "<p>a<p>b</b></i>"), (6, "<a title=\"open"), (6, "<a title=\"open"),
            (7, "<!-- only"), (8, "<script>x</script>")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, html string, url string")
    got = [(r["page_id"], r["text"]) for r in html.with_text(frame, forest).collect()]
    assert len(got) == len(rows) and all(t is not None for _, t in got)
    assert dict(got)[1] == dict(got)[2] == dict(got)[7] == dict(got)[8] == "" and dict(got)[3] == "plain < text"
    assert html.with_text(frame.where("false"), html.fit(frame.where("false"))).count() == 0


def test_rare_pages_that_tell_are_found(spark):
    told = "<article><h1>Title {0}</h1><p>Paragraph {0}, with a few words of it. And more.</p></article><nav>Home</nav>"
    rows = [(i, told.format(i) if i % 100 == 7 else f"<p>only an article of {i} words</p>") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    order = [r["page_id"] for r in pages.where("page_id % 100 = 7").orderBy(F.xxhash64("page_id")).collect()]
    for most in (2, 4):
        got, want = html.fit(pages, sample_rows=most), html.learn([rows[i][1] for i in order[:most]])
        assert (got.feature == want.feature).all() and (got.leaf == want.leaf).all()


# --- pipeline ---------------------------------------------------------------------------

def test_pipeline_against_plain_versions(spark, tokenizer):
    import corpus_pipeline

    from codequarry.llm import decontaminate, quality
    from codequarry.plans.checkpoints import cut

    from .brute import edit_infix, near_components, repeats

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    schema = docs.schema
    by_name = dict(corpus_pipeline.STAGES)
    good = cut(by_name["quality"](spark, docs, SF))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels, usable=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    want = {r["doc_id"] for r in quality.with_score(docs, model, "s").collect() if r["s"] >= quality.THRESHOLD}
    assert {r["doc_id"] for r in good.collect()} == want and good.schema == schema

    single = cut(by_name["near_duplicates"](spark, good, SF))
    texts = [(r["doc_id"], r["text"]) for r in good.collect()]
    named = near_components(texts, 5, 80)
    assert {r["doc_id"] for r in single.collect()} == {i for i, (_, c) in named.items() if i == c} and single.schema == schema

    fresh = cut(by_name["suffix_dedup"](spark, single, SF))
    kept = repeats([(r["doc_id"], r["text"]) for r in single.collect()], 50)
    was = {r["doc_id"]: r["text"] for r in single.collect()}
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in fresh.collect()} == {
        i: (t, len(t)) for i, (k, n, _) in kept.items() if not n or k for t in [k.decode(errors="ignore") if n else was[i]]}
    assert fresh.schema == schema

    clean = cut(by_name["decontamination"](spark, fresh, SF))
    items = [decontaminate.folded(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = {r["doc_id"] for r in fresh.collect()} - {r["doc_id"] for r in clean.collect()}
    for r in fresh.collect():
        body = decontaminate.folded(r["text"])
        if r["doc_id"] in gone:
            assert any(edit_infix(i, body) <= int(0.1 * len(i)) for i in items)
        else:
            assert not any(i in body for i in items)
    rows = by_name["packing"](spark, clean, SF).collect()
    check_packing(rows, [(r["doc_id"], r["text"]) for r in clean.collect()], tokenizer, 4096)


def test_pipeline_takes_odd_documents(spark, tmp_path):
    import corpus_pipeline

    rows = [(1, None, "en", "s", None, 1), (None, "some text", None, None, 9, 1), (3, "same row here", "de", "s", 13, 1), (3, "same row here", "de", "s", 13, 1), (4, "", "fr", "s", 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id int")
    for some in (docs, docs.where("false")):
        now = some
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SF)
            if name != "packing":
                assert now.schema == docs.schema
        assert now.count() == (4 if some is docs else 0)
