"""HTML extraction, tokens, packing, media."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from prismtab.llm import bpe, flac, html_extract, media, pack, token_counts
from prismtab.llm.html_layouts import Layout

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def key(rows):
    return Counter(map(tuple, rows))


@pytest.fixture(scope="module")
def encoding():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


PAGE = """<!DOCTYPE html><html><head><title>No title</title><style>p{}</style><script>var t="</p><p>no script</p>";</script></head><body>
<header><nav><ul><li><a href="/a">Menu</a></li><li><a>More menu</a></li></ul></nav></header><!-- <p>no comment</p> -->
<div class="cookie-notice"><p>We use cookies, accept them all please now.</p></div>
<%s><h1>The  title &amp; more</h1><p><b>First</b> par&shy;agraph, which is lon<i>ger</i>.<br>Second&nbsp;line<p>Another paragraph of the article, quite long too.
<div class="ad">Buy this thing now, it is really cheap today</div><aside>Side note here</aside>
<p>Last words &lt;here&gt; &copy 2024 of the article with some length.</p></%s>
<div id="comments"><div class="comment"><p>I am a reader and I think this is great.</p></div></div>
<form><input name="q"><button>Search</button></form><footer>Footer words &middot; here</footer></body></html>"""


@pytest.mark.parametrize("holder", ["article", "div", "main", "section"])
def test_article_only(holder):
    text, score = html_extract.extract(PAGE % (holder, holder))
    assert text == "The title & more First par\xadagraph, which is longer. Second line Another paragraph of the article, quite long too. Last words <here> © 2024 of the article with some length."
    assert score > 0


def test_marks():
    body = "<p>" + "One sentence of the article after another. " * 5 + "</p>"
    for page in (f"<div class='page no-sidebar comments-open'>{body}</div>", f"<main class='has-sidebar'>{body}</main>", f"<article class='post'>{body}</article><ol class='commentlist'><li><article class='comment-body'><p>A reader says so and so.</p></article></li></ol>"):
        assert html_extract.extract(page)[0] == ("One sentence of the article after another. " * 5).strip()


def without_lists(page: str) -> str:
    """The article's words as labelled, all elements of an article's inside being text."""
    import html
    import re

    return " ".join(html.unescape(re.sub("<[^>]*>", " ", page)).split())


def held_out_layouts(named: bool):
    made = [Layout(random.Random(f"held out {i}")) for i in range(200)]
    return [x.page() for x in made if x.named == named]


@pytest.mark.parametrize(("named", "least"), [(True, 0.9), (False, 0.65)])
def test_region_of_layouts_that_were_not_learned(named, least):
    pages = held_out_layouts(named)
    right = [" ".join(html_extract.extract("".join(m for _, m in p))[0].split()) == without_lists(" ".join(m for k, m in p if k == 1)) for p in pages]
    assert sum(right) >= least * len(pages) > 60


def test_the_scan_is_what_finds_unnamed_articles(monkeypatch):
    pages = held_out_layouts(False)
    monkeypatch.setattr(html_extract, "region", lambda items: (0, len(items), 1.0))
    right = [" ".join(html_extract.extract("".join(m for _, m in p))[0].split()) == without_lists(" ".join(m for k, m in p if k == 1)) for p in pages]
    assert sum(right) < 0.1 * len(pages)


def test_tables_stay():
    rows = "".join(f"<tr><td>cell {i}</td><td>{i}</td><td>x</td></tr>" for i in range(30))
    for holder in ("article", "main", "div"):
        text, _ = html_extract.extract(f"<html><body><nav><a>Menu</a></nav><{holder}><h1>Title words</h1><table>{rows}</table><p>One sentence follows the table.</p></{holder}><footer>Foot</footer></body></html>")
        assert text == "Title words " + " ".join(f"cell {i} {i} x" for i in range(30)) + " One sentence follows the table."


@pytest.mark.parametrize("page", ["<script " * 125_000, "<i>" * 100_000 + "</b>" * 100_000, "<a '\"" * 100_000, "<a \"<a\" " * 100_000 + "'", "<!--" * 200_000, "</script" * 100_000, "<" * 300_000, "<div>" * 100_000, "<p class='" + "x " * 300_000 + "'>a"])
def test_hostile_pages_take_one_pass(page):
    import time

    html_extract.weights()
    began = time.process_time()
    html_extract.extract(page)
    assert time.process_time() - began < 3


def test_page_edges(spark):
    pages = [(1, "u", None), (2, None, ""), (None, "v", "just words & more"), (4, "w", "<p>cut &am"), (5, "x", "<p>a</p>" * 3), (5, "x", "<p>a</p>" * 3), (6, "y", "<script>never closed <p>x</p>"), (7, "z", "< 3 is less <p title='a>b'>than four</p>")]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, text string")
    got = key((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in html_extract.extract_pages(df).collect())
    want = [(1, "u", ""), (2, None, ""), (None, "v", "just words & more"), (4, "w", "cut &am"), (5, "x", "a a a"), (5, "x", "a a a"), (6, "y", ""), (7, "z", "< 3 is less than four")]
    assert got == key((*w, len(w[2])) for w in want)
    assert html_extract.extract_pages(df.limit(0)).count() == 0


def test_region_is_the_best_run():
    items = html_extract.tokens(PAGE % ("div", "div"))
    weight, other = html_extract.weights()
    assert weight[""] > 0 and weight["a"] < 0 and all(w < 0 for k, w in weight.items() if k[:1] in "<!" and k) and other < 0
    value = [weight.get(i.key, other) if i.text is None else weight[i.key] * i.words for i in items]
    best = max(sum(value[a:b]) for a in range(len(value)) for b in range(a + 1, len(value) + 1))
    lo, hi, score = html_extract.region(items)
    assert score == pytest.approx(best) and sum(value[lo:hi]) == pytest.approx(best)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60))
def test_bpe_equals_the_library(text):
    import tiktoken  # noqa: F401

    mine = bpe.loaded(RANKS)
    ids = mine.encode(text).tolist()
    assert ids == _library().encode_ordinary(text) and mine.decode(ids) == text.encode()


def _library(made=[]):  # noqa: B006
    if not made:
        import tiktoken

        with open(RANKS, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        made.append(tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}))
    return made[0]


def test_bpe_digests(docs, empty, corpus, encoding):
    want = []
    for row in corpus:
        t = row[1] or ""
        ids = encoding.encode_ordinary(t)
        want.append((row[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert key(bpe.digests(docs, RANKS).collect()) == key(want) and bpe.digests(empty, RANKS).count() == 0
    round_trip = bpe.decode(bpe.encode(docs, RANKS), RANKS).select("text", "bytes").collect()
    assert all(bytes(r["bytes"]) == (r["text"] or "").encode() for r in round_trip)


def test_packing(docs, empty, corpus):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    size = 256
    want = []
    for row in corpus:
        ids = [*tok.encode(row[1] or "", add_special_tokens=False).ids, 1]
        want += [(row[0], j // size, j, len(ids[j : j + size]), zlib.crc32(np.array(ids[j : j + size], "<u4").tobytes())) for j in range(0, len(ids), size)]
    got = pack.pack(docs, WORDS, size).collect()
    assert key(tuple(r)[:5] for r in got) == key(want)
    rows = defaultdict(list)
    for r in got:
        rows[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in rows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    assert len(rows) <= 1.03 * -(-sum(w[3] for w in want) // size) + 1
    assert pack.pack(empty, WORDS, size).count() == 0


_SIGNS = [*"abAB'stTdlmrevZ019!?.,<|>*&%$#_-^`~@ \n\t\r\x00\x0b\x0c\x1c\x85\xa0\u2003\u0308\u0301", *"ÉéßİıſKΣσς中文😀…“”½²①٣\u200d\ufeff", "'s", "'ll", "don't", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "hello", "WORLD's", "x" * 40]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(_SIGNS), max_size=24).map("".join), st.text(max_size=20)), max_size=5))
def test_ids_are_those_of_the_library(batch):
    import pyarrow as pa

    words = pack.loaded(WORDS)
    ids, offsets = words.encode(pa.array(batch, pa.string()))
    got = [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)]
    literal = type(words.tokenizer).from_file(WORDS) if not hasattr(test_ids_are_those_of_the_library, "tok") else test_ids_are_those_of_the_library.tok
    test_ids_are_those_of_the_library.tok = literal
    assert got == [literal.encode(t or "", add_special_tokens=False).ids for t in batch]


def test_special_tokens_are_tokens():
    import pyarrow as pa

    ids, offsets = pack.loaded(WORDS).encode(pa.array(["hello <|endoftext|> there", "<|startoftext|>x"]))
    assert ids.tolist()[: offsets[1]] == [3306, 49407, 997] and ids.tolist()[offsets[1]] == 49406


def test_a_full_table_of_runs_forgets(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(pack, "SLOTS", 16)
    monkeypatch.setattr(pack, "IDS", 40)
    words, tok = pack.Words(WORDS), pack.loaded(WORDS).tokenizer
    for k in range(6):
        batch = [" ".join(f"w{i}x" for i in range(k, k + 30)), "a" * 300, f"é{k} " * 3]
        ids, offsets = words.encode(pa.array(batch))
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == [tok.encode(t, add_special_tokens=False).ids for t in batch]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_plan_is_best_fit_over_single_pieces(counts):
    slots = pack.best_fit(counts, 40)
    placed = defaultdict(list)
    for length, lo, hi, first, each, base in slots:
        for r in range(lo, hi):
            placed[first + (r - lo) // each].append((base + (r - lo) % each * length, length))
    got = sorted(tuple(sorted(x[1] for x in v)) for v in placed.values())
    rooms: list[list[int]] = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [b for b in rooms if 40 - sum(b) >= length]
            (min(fits, key=lambda b: 40 - sum(b)) if fits else rooms.append([]) or rooms[-1]).append(length)
    assert len(got) == len(rooms) and sum(map(len, got)) == sum(counts.values())
    assert all(sum(x) <= 40 for x in got)
    for v in placed.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length


def test_token_counts(spark):
    lengths = [3, 3, 7, 0, 12, 7, 7]
    rows = {r["limit"]: r for r in token_counts.limits(token_counts.histogram(spark.createDataFrame([(x,) for x in lengths], "length long"))).collect()}
    for limit, r in rows.items():
        assert (r["n_fit"], r["n_longer"]) == (sum(x <= limit for x in lengths), sum(x > limit for x in lengths))
        assert (r["tokens"], r["tokens_truncated"]) == (sum(lengths), sum(min(x, limit) for x in lengths))
    df = token_counts.limits(token_counts.histogram(spark.createDataFrame([(x,) for x in lengths], "length long")))
    assert {r["q"]: r["length"] for r in token_counts.quantiles(df, [0.0, 0.5, 1.0]).collect()} == {0.0: 0, 0.5: 7, 1.0: 12}


def test_token_lengths(docs, empty, corpus):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    e = token_counts.encoding(path)
    got = {r["length"]: r["n_docs"] for r in token_counts.histogram(token_counts.lengths(docs, path)).collect()}
    assert got == Counter(len(e.encode_ordinary(r[1] or "")) for r in corpus)
    assert token_counts.limits(token_counts.histogram(token_counts.lengths(empty, path))).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=3000), min_size=1, max_size=5))
def test_flac_round_trip(payloads):
    streams = flac.encode(payloads)
    assert [b"".join(b.pcm for b in s) for s in flac.decode(streams)] == payloads


def test_flac_kinds_and_seeking():
    wave = bytes((128 + 60 * np.sin(np.arange(9000) / 9)).astype(np.uint8))
    payloads = [wave, b"\x07" * 4000, bytes(np.random.default_rng(1).integers(0, 256, 5000, np.uint8)), b"text with words and blanks " * 200]
    streams = flac.encode(payloads)
    assert len(streams[0]) < len(wave) / 2 and len(streams[1]) < 300
    for p, s in zip(payloads, streams, strict=True):
        for at in (0, 1151, 1152, len(p) - 1):
            b = flac.seek(s, at)
            assert b.offset <= at < b.offset + len(b.pcm) and b.pcm == p[b.offset : b.offset + len(b.pcm)]
    first = flac.parse(streams[3]).first
    for place in (first + 3, first + 40, len(streams[3]) - 1):
        bad = bytearray(streams[3])
        bad[place] ^= 0x10
        with pytest.raises(ValueError):
            flac.decode([bytes(bad)])


def test_flac_partitions_escapes_and_plain_predictors():
    """A frame written by hand: fixed order 2, two partitions, the second escaped to 5 bits, no seek table."""
    x = [10, 12, 15, 19, 24, 30, 37, 45] * 2
    res = [x[t] - 2 * x[t - 1] + x[t - 2] for t in range(2, 16)]
    bits = "".join(f"{v & 255:08b}" for v in (0, 2 << 1 | 16))[8:] + "".join(f"{v & 255:08b}" for v in x[:2]) + "00" + "0001"
    bits += "0011" + "".join("0" * ((2 * r if r >= 0 else -2 * r - 1) >> 3) + "1" + f"{(2 * r if r >= 0 else -2 * r - 1) & 7:03b}" for r in res[:6])
    bits += "1111" + f"{8:05b}" + "".join(f"{r & 255:08b}" for r in res[6:])
    body = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    head = bytes([0xFF, 0xF8, 6 << 4 | 4, 2, 0, 15])
    crc = 0
    for b in head:
        crc = int(flac.CRC8[crc ^ b])
    frame = head + bytes([crc]) + body
    frame += int(flac.crc16(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]))[0]).to_bytes(2, "big")
    pcm = bytes(v + 128 for v in x)
    info = (16).to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | 7 << 36 | 16).to_bytes(8, "big") + hashlib.md5(bytes(v & 255 for v in x)).digest()
    assert flac.decode([b"fLaC\x80\x00\x00\x22" + info + frame])[0][0].pcm == pcm


def test_media(docs, empty, corpus):
    want = []
    for row in corpus:
        t = (row[1] or "").encode()
        p = t + b" " * (-len(t) % 192 or (0 if t else 192))
        want.append((row[0], len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    assert key(tuple(r)[:5] for r in media.digests(media.store(docs)).collect()) == key(want)
    assert media.digests(media.store(empty)).count() == 0
    got = defaultdict(bytes)
    for r in sorted(media.blocks(media.store(docs.filter("doc_id in (60, 61)"))).collect(), key=lambda r: r["sample_offset"]):
        assert len(got[r["doc_id"]]) == r["sample_offset"]
        got[r["doc_id"]] += bytes(r["pcm"])
    by_id = {r[0]: r[1] for r in corpus}
    assert {i: b.rstrip() for i, b in got.items()} == {i: by_id[i].encode() for i in (60, 61)}
