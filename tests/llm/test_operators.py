"""Each operator against a brute-force version, on small tables and on awkward rows."""

import hashlib
import random
import zlib
from base64 import b32encode
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from argusframe.llm import bpe, chat, exact, fingerprint, html, ngram, packing, quality, queries, warc
from argusframe.llm.common import bucket_of, scratch
from pyspark.sql import functions as F

TEXTS = [None, "", " \n ", "word", "two words", "a b c d", "A b C d", "same same same same same", "é漢字 😀 ß", "x" * 5000, "lorem ipsum " * 2000, "two words", None, "<|endoftext|> it's 'll", "a\\b </turn> ### c: d\n\n"]


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, ties, repeated rows, long texts, and columns named like results."""
    rows = [(i, t, "x", i) for i, t in enumerate(TEXTS)] + [(1, "", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, score long")


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.where("false")


def docs_of(small):
    return duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet' ORDER BY doc_id").fetchall()


def test_bpe(spark, small, awkward, empty):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(queries.vocabulary())
    for docs, rows in ((None, docs_of(small)), (awkward, [(i, t) for i, t in enumerate(TEXTS)] + [(1, "")])):
        found = bpe.encode(docs, queries.vocabulary()).collect() if docs else queries.op7_bpe(spark, small).collect()
        want = []
        for i, t in rows:
            ids = tool.encode(t or "", add_special_tokens=False).ids
            want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(tool.decode(ids, skip_special_tokens=False))))
        assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == sorted(want)
    assert bpe.encode(empty, queries.vocabulary()).count() == 0


def test_bpe_random_words():
    from tokenizers import Tokenizer

    tool, own, r = Tokenizer.from_file(queries.vocabulary()), bpe.encoder(bpe.read_spec(queries.vocabulary())), random.Random(5)
    texts = ["".join(r.choice("ab'srtvelmdLL01²½ \t\n\r\u3000é漢!?.<|>😀aa") for _ in range(r.randint(0, 50))) for _ in range(3000)]
    assert [list(x) for x in own.encode(texts)] == [x.ids for x in tool.encode_batch(texts, add_special_tokens=False)]


def check_pieces(rows, ids_of, limits):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length, r.loss_tokens))
    for doc, ids in ids_of.items():
        at = 0
        for start, length, crc, total in sorted(pieces.pop(doc)):
            assert start == at and length > 0 and total == len(ids)
            assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    assert not pieces
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= limits.tokens and len(parts) <= limits.segments and sum(x[2] for x in parts) <= limits.loss
        padding += 0 if at & (at - 1) == 0 else limits.tokens - at
    return padding


def test_packing(spark, small, awkward, empty):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(queries.vocabulary())
    ids = {i: tool.encode(t, add_special_tokens=False).ids + [1] for i, t in docs_of(small)}
    assert check_pieces(queries.op1_packing(spark, small).collect(), ids, packing.Limits()) == 0
    once = awkward.dropDuplicates(["doc_id"])
    ids = {i: tool.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(TEXTS)}
    assert check_pieces(packing.pack(once, queries.vocabulary()).collect(), ids, packing.Limits()) == 0
    tight = packing.Limits(tokens=64, segments=3, loss=40)
    check_pieces(packing.pack(once, queries.vocabulary(), tight).collect(), ids, tight)
    assert packing.pack(empty, queries.vocabulary()).count() == 0


def test_packing_instruction_data(spark):
    """Prompts bear no loss: the loss limit binds before the token limit, and loss tokens are the answers' and end ids."""
    from tokenizers import Tokenizer

    tool, r = Tokenizer.from_file(queries.vocabulary()), random.Random(1)
    words = lambda n: " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n))
    rows = [(i, words(r.randint(0, 40)), words(r.randint(0, 60))) for i in range(80)] + [(100, None, None), (101, "only a prompt", None)]
    size = lambda t: len(tool.encode(t or "", add_special_tokens=False).ids)
    limits = packing.Limits(tokens=128, segments=4, loss=64)
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, prompt string, text string"), queries.vocabulary(), limits, prompt_col="prompt").collect()
    lengths, losses, sequences = defaultdict(int), defaultdict(int), defaultdict(list)
    for x in found:
        lengths[x.doc_id] += x.length
        losses[x.doc_id] += x.loss_tokens
        sequences[x.sequence_id].append(x)
    assert dict(lengths) == {i: size(p) + size(t) + 1 for i, p, t in rows} and dict(losses) == {i: size(t) + 1 for i, p, t in rows}
    assert all(sum(x.length for x in q) <= 128 and len(q) <= 4 and sum(x.loss_tokens for x in q) <= 64 for q in sequences.values())


def test_packing_takes_the_largest_dot_product():
    packer = packing.Packer(packing.Limits(10, 8, 10))
    for example, n in enumerate((4, 6, 3, 7)):
        packer.add(example, n, 0)
    found = defaultdict(list)
    for example, a, b, sequence, _ in packer.pack(True):
        found[sequence].append((example, a, b))
    assert found[0] == [(3, 0, 7), (2, 0, 3)] and found[1] == [(1, 0, 6), (0, 0, 4)]


def test_exact(spark, small, awkward, empty):
    for docs, rows, keep in ((None, docs_of(small), "max"), (awkward, [(i, t) for i, t in enumerate(TEXTS)] + [(1, "")], "min")):
        found = (exact.mark(docs, keep=keep) if docs else queries.op9_exact(spark, small)).collect()
        groups = defaultdict(list)
        for i, t in rows:
            groups[t or ""].append(i)
        best = max if keep == "max" else min
        want = sorted((i, best(groups[t or ""]), len(groups[t or ""]), sha(t or "")) for i, t in rows)
        assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == want
        assert sorted(r.doc_id for r in found if r.kept) == sorted(best(g) for g in groups.values())
    left = exact.deduplicate(awkward)
    assert left.columns == awkward.columns and left.count() == len({t or "" for t in TEXTS})
    assert exact.mark(empty).count() == 0


def test_chat(spark, small):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{small}/conversations.parquet' ORDER BY 1, 2").fetchall()
    rows += [(-7, 0, "user", queries.HARD_TURN), (-7, 1, "assistant", queries.HARD_TURN)]
    turns = defaultdict(list)
    for c, _, role, text in rows:
        turns[c].append((role, text or ""))
    want = {c: (len(t), sha("".join(f"{r}\n{x}\n" for r, x in t)), sum(len(x) for r, x in t if r == "assistant"), sha("".join(x for r, x in t if r == "assistant"))) for c, t in turns.items()}
    found = queries.op4_chat(spark, small).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in found} == want


def test_chat_awkward(spark):
    r = random.Random(2)
    parts = ["\\", "b", "l", "<", "</turn>", "</turn>\n", "### ", "#", "\n", ":\n", "é", "assistant", "\\b", "\\l", " "]
    texts = [None, "", *["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(300)]]
    rows = [(i // 150, i, r.choice(["user", "assistant", "a:\n#b", None, ""]), t, 1) for i, t in enumerate(texts)]
    rows += [(9, None, "user", "x", 1), (9, 1, "user", "x", 1), (9, 1, "user", "x", 1), (None, 1, "user", "lost", 1)]
    found = {x.conv_id: x for x in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted long")).collect()}
    for c in (0, 1, 2):
        own = [x for x in rows if x[0] == c]
        assert found[c].turns == "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own)
        assert found[c].loss_text == "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert found[c].formatted.count("</turn>") == len(own) == found[c].n_turns
        masked = [found[c].formatted[s.start : s.start + s.length] for s in found[c].loss_spans]
        assert len(masked) == sum(x[2] == "assistant" for x in own)
    assert found[9].turns == "user\nx\n" * 3 and found[None].n_turns == 1
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_fingerprint(spark, small, awkward, empty):
    docs = {i: t for i, t in docs_of(small)}
    order = sorted(docs, reverse=True)
    found = {r.doc_id: r for r in queries.op10_fingerprint(spark, small).collect()}
    assert set(found) == set(docs)
    errors = []
    for at, i in enumerate(order):
        following = docs[order[(at + 1) % len(order)]]
        cut = len(docs[i]) // 3
        edited = docs[i][: len(docs[i]) - cut] + following[:cut]
        assert found[i].n_chars == len(docs[i]) and found[i].edited_sha256 == sha(edited)
        shingles = [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for w in (docs[i].split(), edited.split(), following.split())]
        for name, other in (("near_edited", shingles[1]), ("near_next", shingles[2])):
            errors.append(abs(found[i][name] - len(shingles[0] & other) / len(shingles[0] | other)))
    assert np.mean(errors) < 0.05
    rows = fingerprint.fingerprint_edits(awkward).collect()
    assert len(rows) == len(TEXTS) + 1 and {len(r.text_sketch.low) == 0 and r.text_sketch.least is None for r in rows if not (TEXTS[r.doc_id] or "").strip()} == {True}
    assert fingerprint.fingerprint_edits(empty).count() == 0


def test_fingerprint_merges(spark):
    """Sketches of parts merge into the sketch of the whole at any scale, and containment of a short part in a long text is near 1."""
    r = random.Random(3)
    words = [f"w{r.randrange(10**6)}" for _ in range(6000)]
    cut = [" ".join(words[a:b]) for a, b in ((0, 6000), (0, 3000), (2996, 6000), (1000, 1400), (7, 12), (2000, 2005))]
    row = spark.createDataFrame([tuple(cut)], "whole string, one string, two string, part string, five string, other string")
    for scale in (4, 10**6):
        of = {c: fingerprint.sketch(F.col(c), scale=scale) for c in row.columns}
        found = row.select(fingerprint.merge(of["one"], of["two"]).alias("m"), of["whole"].alias("w"), fingerprint.merge(of["five"], of["other"]).alias("f"), fingerprint.containment(of["part"], of["whole"]).alias("c"), fingerprint.containment(of["five"], of["other"]).alias("n")).first()
        assert found.m == found.w and found.n == 0.0 and (scale > 4 or found.c == 1.0)
        assert all(x < 2**63 // scale for x in found.f.low)


def test_word_hashes_of_regular_words(spark):
    """A long regular word and its complement, whose polynomial hashes agree modulo 2**64, are different words."""
    one = "a"
    for _ in range(11):
        one += one.translate(str.maketrans("ab", "ba"))
    two = one.translate(str.maketrans("ab", "ba"))
    found = ngram.link(spark.createDataFrame([(1, one), (2, two), (3, one.upper())], "doc_id long, text string")).collect()
    assert {x.doc_id: x.component_id for x in found} == {1: 1, 2: 2, 3: 1}


def test_bucket_of(spark):
    bounds = [-5, 0, 3, 4, 9]
    found = spark.range(-10, 20).select("id", bucket_of(F.col("id"), bounds).alias("b")).collect()
    assert all(r.b == sum(x <= r.id for x in bounds) for r in found)


def test_warc(spark, small, tmp_path):
    pages = duckdb.sql(f"SELECT page_id, url, html FROM '{small}/pages.parquet'").fetchall()
    extra = [(900_001, None, None, 1), (900_000, "http://x/ é\n", "", 1), (900_002, "u", pages[0][2], 1), (900_003, "u", "twice", 1), (900_003, "u", "twice", 1), (None, "u", "lost", 1)]
    rows = spark.createDataFrame([(*p, 1) for p in pages] + extra, "page_id long, url string, html string, sha long")
    paths = [f"{tmp_path}/a", f"{tmp_path}/b"]
    for p in paths:
        warc.write_archive(rows.repartition(3 if p == paths[0] else 7), p, roll_bytes=20_000, bounds=[10, 40, 500_000])
    listed = [sorted(warc.read_archive(spark, p).sparkSession.read.parquet(f"{p}/manifest").collect()) for p in paths]
    assert listed[0] == listed[1] and len(listed[0]) > 4
    assert all(hashlib.sha256(open(f"{paths[0]}/data/{m.file}", "rb").read()).hexdigest() == m.sha256 for m in listed[0])
    first = {}
    everything = [(i, (h or "").encode()) for i, _, h, *_ in [*pages, *extra] if i is not None]
    for i, h in everything:
        first[h] = min(i, first.get(h, i))
    want = sorted((i, len(h), b32encode(hashlib.sha1(h).digest()).decode(), "response" if first[h] == i else "revisit", None if first[h] == i else first[h]) for i, h in everything)
    found = warc.read_archive(spark, paths[0], with_payload=True).collect()
    key = lambda x: tuple(str(y) for y in x)
    assert sorted([tuple(r)[:5] for r in found], key=key) == sorted(want, key=key)
    assert {bytes(r.payload) for r in found if r.payload is not None} == set(first)
    assert warc.write_archive(rows.where("false"), scratch(spark, "none")).count() == 0


def test_html(spark, small, awkward):
    rows = queries.op3_html(spark, small).collect()
    assert len(rows) == duckdb.sql(f"SELECT count(*) FROM '{small}/pages.parquet'").fetchall()[0][0]
    assert all(r.text and r.n_chars == len(r.text) and "track(" not in r.text for r in rows)
    odd = awkward.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"), F.lit(1).alias("text"), F.lit(2).alias("path"))
    assert html.extract_pages(odd).count() == len(TEXTS) + 1 and html.extract_pages(odd.where("false")).count() == 0


def test_html_page():
    page = """<html><head><title>x</title></head><body><header><h1>Site</h1></header><div class="wrap c12"><div class="sidebar"><p>side bar</p></div><div class="post-body"><h1>Title &amp; more</h1>
    <p>Para  one is long enough, yes it is.<p>Para <b>two</b><br>line &lt;b&gt; &#233;</p><script>var a = "</p>";</script><ul><li>One<li>Two</ul><div class="advert">buy</div><form><p>mail</p></form></div>
    <div id="comments"><p>A reader says a very long thing, at length, and on, and on, and on, and on, and on.</p></div></div><footer>f</footer><div class="cookie-notice">c</div></body>"""
    want = "Title & more\nPara one is long enough, yes it is.\nPara two line <b> é\nOne\nTwo"
    assert html.extract(page, None) == want == html.extract(page, "body/div.cN.wrap/div.post-body") == html.extract(page, "body/none")
    assert html.extract("", None) == "" == html.extract("<nav>menu</nav>", None)


def test_html_split_article():
    lead, text, more = "lead " * 60, "body " * 400, "more " * 300
    squeezed = lambda *x: "\n".join(y.strip() for y in x)
    split = f'<body><div class="top"><p>site text</p></div>%s<div class="lead"><p>{lead}</p></div><div class="body"><p>{text}</p></div>%s</body>'
    for a, b, best in (("<article>", "</article>", "body/article/div.body"), ('<div class="post">', "</div>", "body/div.post/div.body")):
        assert html.extract(split % (a, b), best) == html.extract(split % (a, b), None) == squeezed(lead, text)
    block = '<div class="block"><p>%s</p></div>'
    for a, b, best in (("<article>", "</article>", "body/article/div.block"), ("<section>", "</section>", "body/section/div.block")):
        page = f"<body>{a}{block % text}<h2>Heading</h2>{block % more}Loose words{block % lead}{b}<div><p>{lead}</p></div></body>"
        assert html.extract(page, best) == squeezed(text, "Heading", more, "Loose words", lead)
    links = f'<body><div class="wrap"><div class="body"><p>{text}</p></div><div class="x"><p><a href="/">{lead}</a></p></div></div></body>'
    assert html.extract(links, "body/div.wrap/div.body") == text.strip()


@pytest.mark.parametrize("wrapper", ["layout has-sidebar", "with-comments", "no-header", "page-legal", "sidebar-layout", "promo-2024"])
def test_html_wrappers(wrapper):
    """A class that tells of a layout, or that names nearly the whole page, doesn't take the article away; parts in it still go."""
    title, text, side = "A title", "prose of the article " * 40, "side words " * 5
    page = f'<body><nav><a href="/">home</a></nav><div class="{wrapper}"><div class="sidebar"><p>{side}</p></div><div class="post"><h1>{title}</h1><p>{text}</p></div></div><footer>end</footer></body>'
    assert html.extract(page, None) == f"{title}\n{text.strip()}"
    assert html.extract(f'<body><div class="ad">{side}</div></body>', None) == ""
    comments = f'<article><h1>{title}</h1><p>{text}</p></article><section class="comments"><article><p>{text * 30}</p></article></section>'
    assert html.extract(comments, None) == f"{title}\n{text.strip()}"


def test_html_generated(spark):
    """Articles of known text in many templates, among parts that go, one host with a rare template: exact texts, long and empty pages."""
    r, rows, want = random.Random(9), [], {}
    words = lambda n: " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 9))) for _ in range(n))
    shells = ["<article>%s</article>", '<main><section class="s1">%s</section></main>', '<div class="page has-sidebar"><div class="post-body">%s</div><div class="sidebar-left"><p>' + words(30) + "</p></div></div>", '<div id="content">%s</div>']
    around = ['<div class="ad">%s</div>', '<aside><p>%s</p></aside>', '<div class="cookie-notice"><p>%s</p></div>', '<form><p>%s</p><input name="q"></form>', '<section id="comments"><p>%s</p></section>', '<ul class="related-posts"><li>%s</li></ul>', "<script>var x = '%s';</script>", "<!-- %s -->", '<div class="newsletter-signup">%s</div>', '<p hidden>%s</p>']
    for i in range(200):
        blocks = [words(r.randint(5, 60)) for _ in range(r.randint(3, 12) if i else 4000)]
        tags = [r.choice(["p", "p", "p", "h2", "blockquote", "pre"]) for _ in blocks]
        inner = "".join(f"<{t}>{b.replace(' ', r.choice([' ', '  ', chr(10)]), 1)} &amp; &#233;</{t}>" for t, b in zip(tags, blocks, strict=True))
        parts = [x % words(8) for x in r.sample(around, 4)]
        rows.append((i, f"https://h{i % 3}.example/{i}", "<html><head><title>t</title></head><body><header><p>site</p></header>" + "".join(parts[:2]) + shells[i % 4] % inner + "".join(parts[2:]) + "<footer>f</footer></body></html>"))
        want[i] = "\n".join(f"{b} & é" for b in blocks)
    rows += [(500, None, None), (501, "", ""), (0, *rows[0][1:])]
    found = html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(found) == len(rows) and {x.page_id: x.text for x in found} == want | {500: "", 501: ""}


def test_html_votes(spark):
    good = '<body><div class="a1"><p>%s</p></div><div class="b"><p>%s</p></div></body>'
    rows = [(i, "http://h.x/1", good % ("prose " * (40 if i < 5 else 8), "other " * (3 if i < 5 else 9))) for i in range(6)]
    found = {r.page_id: r.text for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[5] == ("prose " * 8).strip()  # its own best is the other container


def test_quality(spark, small, awkward, empty):
    found = queries.op8_quality(spark, "/root/testdata/sf0.01").collect()
    truth = dict(duckdb.sql("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'").fetchall())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    held = [(r.predicted, truth[r.doc_id]) for r in found if r.held_out and r.doc_id in truth]
    assert np.mean([a == b for a, b in held]) > 0.93
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(9)] + [(3, 0, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    scored = quality.score(awkward, quality.train(awkward, labels))
    assert scored.columns == ["doc_id", "text", "kept", "score"] and scored.count() == len(TEXTS) + 1
    assert quality.score(empty, quality.train(empty, labels)).count() == 0
    assert {r.score for r in quality.score(awkward, quality.train(awkward, labels.where("false"))).collect()} == {0.5}
