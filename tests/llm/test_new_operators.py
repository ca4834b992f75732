"""Token alignment, spelling variants and HTML extraction against brute force, on small tables and odd rows."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barloom.llm import align, html_text, queries, variants

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD_TEXTS = [None, "", " ", "a", "  two  spaces ", "tab\tand\nlines\r\n", "a▁b", "ends in space ", "<|endoftext|> and <s> </s> plain", " nbsp　wide", "日本語のテキスト と 漢字", "emoji 🙂🙂 zwj 👩‍👩‍👧", "\0 nul", "x" * 5000, "ab " * 3000, "same text", "same text"]


def odd_docs(spark, texts=ODD_TEXTS, id_type="long"):
    rows = [(None if k == 3 else k, t, "l", 1, 2.0) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id {id_type}, text string, n_links string, pairs int, block double")


def byte_of():
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, k = {chr(b): b for b in own}, 0
    for b in range(256):
        if b not in own:
            table[chr(256 + k)] = b
            k += 1
    return table


def alignment_truth(rows):
    """(doc_id, text) rows, by whole texts and sets of ends."""
    tokenizer, pieces, table = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_of()
    tokenizer.encode_special_tokens = True
    names = {i: t for t, i in tokenizer.get_vocab().items()}
    entry = lambda i: bytes(map(table.get, names[i]))
    spelt = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(pieces.id_to_piece, range(pieces.get_piece_size()))]
    each, counts = [], Counter()
    for doc_id, text in rows:
        a = tokenizer.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        bytes_a, bytes_b = [entry(i) for i in a], [spelt[i] for i in b]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            each.append((doc_id, 0, 0, 0, "", []))
            continue
        ends_a, ends_b = np.cumsum([*map(len, bytes_a)]).tolist(), np.cumsum([*map(len, bytes_b)]).tolist()
        shared = sorted(set(ends_a) & set(ends_b))
        at_a, at_b = ([n + 1 for n, x in enumerate(ends) if x in both] for ends, both in ((ends_a, set(shared)), (ends_b, set(shared))))
        at_a, at_b = [*at_a], [*at_b]
        groups = [",".join(map(str, a[i:j])) + "|" + ",".join(map(str, b[k:m])) for i, j, k, m in zip([0, *at_a], at_a, [0, *at_b], at_b)]
        links = [(a[i - 1], b[j - 1]) for i, j in zip(at_a, at_b)]
        counts.update(links)
        each.append((doc_id, len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest(), links))
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return sorted(((d, na, nb, g, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), sha) for d, na, nb, g, sha, links in each), key=str)


def aligned_rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


def test_alignment(spark, small):
    out = queries.op11_token_alignment(spark, small)
    assert out.columns[:1] == ["doc_id"] and all(t == "bigint" for c, t in out.dtypes if c != "groups_sha256")
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert aligned_rows(out) == alignment_truth(rows)


@pytest.mark.parametrize("chars", [1, 1 << 22])
def test_alignment_odd(spark, monkeypatch, chars):
    """Blocks of one document, and all in one block."""
    monkeypatch.setattr(align, "BLOCK_CHARS", chars)
    docs = odd_docs(spark).coalesce(1)
    assert aligned_rows(align.alignment(docs, A, B)) == alignment_truth([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert align.alignment(docs.where("false"), A, B).count() == 0
    named = align.alignment(odd_docs(spark, ["x y z"] * 3, "string"), A, B)
    assert [r["count_sum"] for r in named.collect()] == [9] * 3 and named.schema["doc_id"].dataType.simpleString() == "string"


def test_alignment_of_long_text(spark):
    text = " ".join(random.Random(3).choices(["alpha", "béta", "gamma,", "8" * 40, "=" * 70, "\n\n\t  x"], k=40_000))
    docs = spark.createDataFrame([(1, text), (2, "alpha gamma,")], "doc_id long, text string")
    assert aligned_rows(align.alignment(docs, A, B)) == alignment_truth([tuple(r) for r in docs.collect()])


def test_shared_cuts_by_brute_force():
    draw = random.Random(5)
    for _ in range(300):
        sizes = [[draw.randint(1, 6) for _ in range(draw.randint(1, 40))] for _ in range(2)]
        ends = [np.cumsum(x) for x in sizes]
        short = 0 if ends[0][-1] < ends[1][-1] else 1
        if gap := int(ends[1 - short][-1] - ends[short][-1]):
            ends[short] = np.append(ends[short], ends[short][-1] + gap)
        found = align.shared_cuts(*ends, *[np.array([x]) for x in (0, len(ends[0]), 0, len(ends[1]))])
        shared = np.intersect1d(*ends)
        assert [e[k].tolist() for e, k in zip(ends, found)] == [shared.tolist()] * 2


def words_truth(rows, shortest=7, least=2, times=10):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= shortest
    vocab = {w: n for w, n in counts.items() if n >= least}
    holes = defaultdict(set)
    for w in vocab:
        for k in range(len(w)):
            holes[w[:k] + "\0" + w[k + 1 :]].add(w)
    near = {w: set() for w in vocab}
    for w in vocab:
        for k in range(len(w)):
            near[w] |= holes[w[:k] + "\0" + w[k + 1 :]] - {w}
            if (shorter := w[:k] + w[k + 1 :]) in vocab:
                near[w].add(shorter)
                near[shorter].add(w)
    forms = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-vocab[x], x), default=None)
        forms[w] = best if best is not None and vocab[best] >= times * vocab[w] else None

    def root(w):
        while forms[w]:
            w = forms[w]
        return w

    return sorted((w, forms[w], root(w), n, len(near[w]), vocab[forms[w]] if forms[w] else None) for w, n in vocab.items())


def variant_rows(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_variants(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    out = queries.op12_spelling_variants(spark, small)
    found = variant_rows(out)
    assert found == words_truth(rows) and len(found) > 1000
    assert dict(out.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}


@pytest.mark.parametrize("symbols", [4, 7, 26])
def test_variants_planted(spark, symbols):
    """Edits at every place, chains of forms, ties, hot words and letters beyond a-z."""
    draw, texts = random.Random(8), []
    letters = "abcdefgzàéÿß×"
    for base in ("banana" * 2, "aaaaaaa", "aaaaaaaa", "received", "ÀÉéàÿßx"):
        words = {base}
        for _ in range(60):
            k, c = draw.randrange(len(base)), draw.choice(letters)
            words.add(draw.choice([base[:k] + c + base[k + 1 :], base[:k] + c + base[k:], base[:k] + base[k + 1 :]]))
        texts += [" ".join([w] * draw.choice([2, 3, 20, 30, 400])) for w in sorted(words)]
    texts += [" ".join(["chainedx"] * 2), " ".join(["chainedxy"] * 30), " ".join(["chainedxyz"] * 400), " ".join(["chainedxyzw"] * 6000), None, "", "short", "x" * 200_000, "Zebrafish" * 2 + "\n" + "Zebrafish" * 2]
    rows = [(k if k % 9 else None, t, k) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word int")
    found = variant_rows(variants.variants(docs, symbols=symbols))
    assert found == words_truth([r[:2] for r in rows])
    assert any(form and root != form for _, form, root, *_ in found)
    assert variants.variants(docs.where("false")).count() == 0


def test_variants_in_blocks(spark, monkeypatch):
    """A long text is read in blocks without cutting a run."""
    monkeypatch.setattr(variants, "BLOCK", 10)
    text = " ".join(random.Random(1).choices(["wonderful", "Wunderbar", "añoranza", "a", "--", "12"], k=3000))
    docs = spark.createDataFrame([(5, text)], "doc_id long, text string")
    assert variant_rows(variants.variants(docs)) == words_truth([(5, text)])


def test_symbols_follow_the_vocabulary():
    assert [variants.symbols_for(n) for n in (0, 4**8, 4**8 + 1, 10**6, 10**9)] == [4, 4, 5, 6, 14]


def article_truth(page):
    """Blocks of the one article of a generated page."""
    blocks = re.split("</?(?:p|h1)>", re.search("<article>(.*)</article>", page, re.S)[1])
    texts = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks]
    return "\n\n".join(filter(None, texts))


def test_pages(spark, small):
    rows = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    out = queries.op13_html_text(spark, small)
    assert out.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    found = {r["page_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert found == {k: (t := article_truth(page), len(t)) for k, page in rows.items()}


FURNISHED = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header class="site-header"><a href="/">Home</a> The Daily Example</header>
<nav><ul><li><a href="/a">News</a><li><a href="/b">Sport</a></ul></nav><div class="cookie-banner"><p>We use cookies on this site. Accept all of them now, they are good for you.</p><button>OK</button></div>
<div id="content" class="post"><h1>A title &amp; more</h1><p>First paragraph of the text, with <a href="x">a link</a> and &lt;marks&gt;.<br>Next   line.</p><div class="ad">Buy this thing now. It is cheap, and it is good.</div>
<aside>A side note that is long enough to look like text. It has sentences.</aside><ul><li>One point</li><li>Second point</li></ul><script>var x = "<p>no</p>";</script><p>The last paragraph &copy 2020 &am.</p>
<section id="comments"><h2>Comments</h2><div class="comment"><p>I like this text a lot, thanks for writing it down for us all. It is good.</p></div></section></div>
<form action="/s"><p>Subscribe now, and get the best of our articles every day in your mail.</p><input name=q></form><div hidden><p>A hidden paragraph which is as long as any other one. It ends here.</p></div><footer>&copy; Example. All rights reserved.</footer></body></html>"""
FURNISHED_TEXT = "A title & more\n\nFirst paragraph of the text, with a link and <marks>. Next line.\n\nOne point\n\nSecond point\n\nThe last paragraph © 2020 &am."


def test_pages_without_the_mark_and_with_other_parts(spark, small):
    """The model, fitted on one kind of page, reads another one and pages whose article isn't marked."""
    pages = spark.read.parquet(f"{small}/pages.parquet")
    model = html_text.fit(pages)
    assert model != html_text.Model()
    assert html_text.main_text(FURNISHED, model) == FURNISHED_TEXT
    assert html_text.main_text(FURNISHED.replace('<div id="content" class="post">', "<article>").replace('</section></div>', "</section></article>"), model) == FURNISHED_TEXT
    plain = [r["html"] for r in pages.collect()]
    unmarked = [p.replace("<article>", '<div class="x1">').replace("</article>", "</div>") for p in plain]
    assert [html_text.main_text(p, model) for p in unmarked] == [article_truth(p) for p in plain]


def test_pages_odd(spark):
    texts = [None, "", "   ", "<p></p>", "<!-- open", "<script>never closed <p>x</p>", "<div " * 50_000, "<b '" * 50_000, "<a x='" * 50_000, "<div>" * 20_000 + "A sentence that is long enough to be the text of a page, all alone.", "<p>" + "Long text, in one block. " * 100_000, "</p></div></html>", "a < b and c > d, which is not a tag at all but a sentence that is long enough to be read as text. Yes.", "<table><tr><td>x<td>y</table>", "&#0;&#x110000;&#xD800;"]
    rows = [(k, "u", t, 9, "own") for k, t in enumerate(texts)]
    pages = spark.createDataFrame(rows + rows[:3], "page_id long, url string, html string, n_chars int, text string")
    model = html_text.fit(pages)
    assert model == html_text.Model(), "no page marks an article"
    out = html_text.extract(pages, model)
    assert out.columns == ["page_id", "url", "html", "text", "n_chars"]
    found = {r["page_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert out.count() == len(texts) + 3 and all(found[k] == ("", 0) for k in (0, 1, 2, 3, 4, 5, 6, 7, 8, 11))
    assert found[9][0].startswith("A sentence") and found[10][1] == 100_000 * 25 - 1 and found[12][0].startswith("a < b and c > d")
    assert html_text.extract(pages.where("false"), html_text.fit(pages.where("false"))).count() == 0


def test_marginals_by_brute_force():
    """Sum-product on a small tree equals the sum over all labellings."""
    import itertools
    import math

    tree, model = html_text.parse("<div class=content><p>Some text of a page.</p><nav><p>Menu text here.</p></nav></div><p>Another text</p>"), html_text.Model()
    odds, _, _ = html_text.messages(tree, model)
    ends, begins, inside = model.edges
    total, on = 0.0, [0.0] * len(odds)
    for labels in itertools.product((0, 1), repeat=len(odds)):
        score = sum(y * (html_text.FIXED if tree.never[i] else sum(model.weights[k] for k in tree.kinds[i])) for i, y in enumerate(labels))
        for i in range(1, len(odds)):
            up, y = labels[tree.parent[i]], labels[i]
            score += 0 if tree.never[i] else ends * (up and not y) + (inside if tree.inside[i] else begins) * (y and not up)
        total += math.exp(score)
        on = [a + y * math.exp(score) for a, y in zip(on, labels)]
    assert all(abs(x / total - 1 / (1 + math.exp(-min(max(o, -700), 700)))) < 1e-9 for x, o in zip(on, odds))


def test_fit_sample_is_of_distinct_pages(spark):
    page = "<body><article><p>{}</p></article></body>"
    pages = spark.createDataFrame([(page.format("copy"),)] * 500 + [(page.format(k),) for k in range(40)] + [(None,), ("<p>unmarked",)], "html string")
    assert html_text.labelled(pages, most=30).count() == 30
    assert html_text.labelled(pages, most=1000).count() == 41
