import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm_samples import HARD, prose
from pyspark.sql import functions as F

from siltstone.llm import decontam, html_density, huffman_ids, line_dedup, minhash_join, suffix_dedup, textkit

import public_tokenizers

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


# ---------------------------------------------------------------- shared byte work


def test_words_and_shingles_match_python():
    texts = ["A bb  ccc\tdd", None, "", "x y", "bb ccc dd a bb ccc dd", " é trail \n", "one"]
    for i, j, data, off in textkit.pieces(pa.array(texts)):
        s, e, f = textkit.words(data, off)
        got = [bytes(data[a:b]).decode() for a, b in zip(s, e)]
        assert got == [w for t in texts for w in (t or "").split()]
        h, row = textkit.shingles(textkit.span_hashes(data, s, e), f, 3)
        values, first = textkit.distinct_by_row(h, row, j - i)
        want = [len({tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))}) if w else 0 for w in ((t or "").split() for t in texts)]
        assert np.diff(first).tolist() == want
        assert (textkit.unpack48(textkit.pack48(values)) == values).all()


# ---------------------------------------------------------------- pages


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>one<p>two", "one\ntwo"),
        ("<body><nav><a href=x>menu</a></nav><div class='ad'>buy</div><article><h1>T &eacute;</h1><p><b>a\n b.<br><p>c &lt;d&gt;</p></article><footer>f</footer>", "T é\na b.\nc <d>"),
        ("<article><p>kept text</p><div id='comments'><p>a reader</p></div><form>f</form><script>var a='</p>'</script><style>p{}</style></article>", "kept text"),
        ("<article><p>x</article><aside>side</aside><div", "x"),
        ("<body><header>site</header><div><div><p>" + "The long main text goes on. " * 8 + "</p><p>" + "And on it goes here. " * 8 + "</p></div></div><div class='sidebar'>s</div><ul class=menu><li><a>m</a></ul></body>", ("The long main text goes on. " * 8).strip() + "\n" + ("And on it goes here. " * 8).strip()),
    ],
)
def test_main_text(page, want):
    assert html_density.main_text(page) == want


def test_raw_elements_after_letters_that_grow():
    assert html_density.main_text("<p>" + "İ" * 60 + "</p><script>x</SCRIPT><p>the whole next paragraph</p><p>end") == "İ" * 60 + "\nthe whole next paragraph\nend"


def test_articles_do_not_hide_denser_text():
    long = "The long main text goes on and has many words. " * 8
    cards = "".join(f"<article><a href=x>teaser number {i} to some other page</a></article>" for i in range(4))
    page = f"<body><div><div><p>{long}</p><p>{long}</p></div></div><div>{cards}</div></body>"
    assert html_density.main_text(page) == f"{long.strip()}\n{long.strip()}"
    parts = f"<body><div><article><p>{long}</p><p>{long}</p></article><article><p>{long}</p><p>{long}</p></article></div></body>"
    assert html_density.main_text(parts) == "\n".join([long.strip()] * 4)


@pytest.mark.parametrize("names", ["layout no-sidebar", "content-with-sidebar", "post has-comments", "elementor-widget elementor-widget-theme-post-content", "widget", "notice"])
def test_names_do_not_drop_the_article(names):
    assert html_density.main_text(f"<body><div class='{names}'><article><p>kept text of the page</p></article></div><div class='sidebar'>s</div></body>") == "kept text of the page"
    long = "The long main text goes on. " * 8
    assert html_density.main_text(f"<body><div class='{names}'><p>{long}</p></div><div class='box sidebar'>s</div></body>") == long.strip()


def test_pages_against_markup(spark):
    import html
    import re

    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", re.sub(r"<br>", " ", inner))]
        assert html_density.main_text(r["html"]) == "\n".join(b for b in blocks if b)


def test_extract_table(spark):
    d = spark.createDataFrame([(1, "<p>a", "clash"), (2, None, "c"), (2, "<p>" + "w " * 100_000, "c")], "page_id long, html string, TEXT string")
    rows = html_density.extract(d).collect()
    assert sorted(r["n_chars"] for r in rows) == [0, 1, 199_999] and html_density.extract(d.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page, want",
    [
        ('<p title="the hidden truth">shown</p><p class="md hidden lg">shown too</p><p hidden>not shown</p>', "shown\nshown too"),
        ("<div class='social-science'><article><p>kept text</p></article></div>", "kept text"),
        ("<p>a <i>b</i> <a href='x>c</a> d</p><p>e</p>", "a b c d\ne"),
        ("<p>5 < 6 and 7 > 6</p>", "5 < 6 and 7 > 6"),
        ("<table><tr><td>a<td>b<tr><td>c</table><ul><li>x<li>y<ul><li>z</ul></ul>", "a\nb\nc\nx\ny\nz"),
        ("<article><span><table><tr><td><b>x</span></b></td></tr></table></article>", "x"),
    ],
)
def test_marks_and_names(page, want):
    assert html_density.main_text(page) == want


@pytest.mark.parametrize("page", ["<a '" * 40_000, "<a '" * 40_000 + "'>'>", "<div>" * 40_000 + "</span>" * 40_000, "<span><table><td>" + "<div>" * 40_000 + "</span>" * 40_000, "<ul>" + "<li><i>" * 40_000, "<p>" + "<b>" * 40_000 + "<br>" * 40_000 + "</p>" * 10, "<" * 200_000, "<!--" * 40_000, "<script>" * 40_000, "<td><tr>" * 30_000, '<a href="' * 40_000 + ">" * 10])
def test_hostile_pages_take_no_long_time(page):
    import time

    begin = time.time()
    html_density.main_text(page)
    assert time.time() - begin < 3


def test_deep_nesting():
    assert html_density.main_text("<div>" * 20_000 + "text" + "</div>" * 20_000) == "text"


# ---------------------------------------------------------------- token files


def test_codes():
    rng = np.random.default_rng(0)
    for n, kinds in ((0, 5), (1, 5), (500, 2), (5000, 300), (70_000, 49_000)):
        ids = (rng.pareto(0.5, n) * 3).astype("int64") % kinds
        counts = np.bincount(ids, minlength=kinds)
        lengths = huffman_ids.code_lengths(counts)
        assert lengths.max(initial=0) <= 16 and (lengths[counts == 0] == 0).all()
        if n > 1 and (counts > 0).sum() > 1:
            assert (0.5 ** lengths[lengths > 0].astype(float)).sum() == 1
        data, offsets = huffman_ids.encode_ids(ids, huffman_ids.canonical(lengths), lengths)
        assert (huffman_ids.decode_ids(data, offsets, n, huffman_ids.decode_table(lengths)) == ids).all()


def test_package_merge_is_optimal():
    import heapq
    import itertools

    rng = random.Random(1)
    for _ in range(30):
        counts = [rng.randrange(1, 50) for _ in range(rng.randrange(2, 12))]
        tick = itertools.count()
        heap = [(c, next(tick)) for c in counts]
        heapq.heapify(heap)
        cost = 0
        while len(heap) > 1:
            a, b = heapq.heappop(heap)[0], heapq.heappop(heap)[0]
            cost += a + b
            heapq.heappush(heap, (a + b, next(tick)))
        lengths = huffman_ids.code_lengths(np.array(counts))
        assert int((lengths * np.array(counts)).sum()) == cost


def test_more_symbols_than_short_codes():
    n = (1 << 16) + 5
    lengths = huffman_ids.code_lengths(np.ones(n, "int64"))
    assert lengths.max() == 17 and (0.5 ** lengths.astype(float)).sum() == 1
    data, offsets = huffman_ids.encode_ids(np.arange(n), huffman_ids.canonical(lengths), lengths)
    assert (huffman_ids.decode_ids(data, offsets, n, huffman_ids.decode_table(lengths)) == np.arange(n)).all()


def thue_morse(n, a="a", b="b"):
    """Words that sums of powers of one odd base can't tell from their complement."""
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


def test_long_words_are_told_apart():
    for n in (16, 17, 1024, 2048):
        x, y = thue_morse(n), thue_morse(n, "b", "a")
        for i, j, data, off in textkit.pieces(pa.array([x, y, "p" + x, x])):
            h = textkit.span_hashes(data, *textkit.words(data, off)[:2])
            assert h[0] != h[1] and h[0] == h[3] and len(set(h)) == 3


def test_words_of_one_hash(monkeypatch):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(TOKENIZER)
    texts = [f"{thue_morse(2048)} one", f"{thue_morse(2048, 'b', 'a')} two one", "three one", "\x00 \x00\x00"]
    monkeypatch.setattr(huffman_ids.WordEncoder, "hash", staticmethod(lambda key: key[:, 2] % np.uint64(2)))  # all but two words collide
    mine = huffman_ids.WordEncoder(TOKENIZER)
    for part in (texts, texts[::-1]):
        got = []
        for _, _, counts, ids in mine.encode_column(pa.array(part), 1):
            got += np.split(ids, np.cumsum(counts)[:-1])
        assert [g.tolist() for g in got] == [whole.encode(t, add_special_tokens=False).ids + [1] for t in part]


ODD = ["İstanbul ΣΑΣ 12.5% don't I'LL we're qu'on", "\xa0nb\x1csp a b", "<|endoftext|> x <|startoftext|>", "é café ​ zero 你好", "ñÑ ÀÉ ßẞ ×÷ ½²", "a<|endoftext|>b", "\x00\x01 \x7f", "Ｆｕｌｌ", "é ñ", "“q” – d l", "x\xad z_y__ $$$ a1b2"]


def test_words_encode_like_the_whole_text():
    from tokenizers import Tokenizer

    whole, mine = Tokenizer.from_file(TOKENIZER), huffman_ids.WordEncoder(TOKENIZER)
    texts = ODD + [prose(i, 60) for i in range(20)] + ["", "  "]
    got = []
    for _, _, counts, ids in mine.encode_column(pa.array(texts), 1):
        got += np.split(ids, np.cumsum(counts)[:-1])
    assert [g.tolist() for g in got] == [whole.encode(t, add_special_tokens=False).ids + [1] for t in texts]


def test_files_round_trip(docs):
    import zlib

    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(TOKENIZER)
    rows = [(i, t) for i, t in enumerate([*ODD, None, "", "w " * 5000, thue_morse(2048), thue_morse(2048, "b", "a")])] + [(1 << 60, "far away")]
    out = sorted(huffman_ids.encode(docs(rows[::-1]), TOKENIZER).collect(), key=lambda r: r["doc_id"])
    start = 0
    for (i, t), r in zip(rows, out):
        ids = whole.encode(t or "", add_special_tokens=False).ids + [1]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    hard = huffman_ids.encode(docs(HARD), TOKENIZER).collect()
    assert len(hard) == len(HARD) and len({r["start"] for r in hard}) == len(HARD)
    lost = sorted(huffman_ids.encode(docs([(None, prose(i, 3)) for i in range(50)] + [(-(1 << 63), "least"), (5, "x")]), TOKENIZER).collect(), key=lambda r: r["start"])
    assert [r["start"] for r in lost] == [0, *np.cumsum([r["n_tokens"] for r in lost])[:-1].tolist()] and [r["doc_id"] for r in lost] == [None] * 50 + [-(1 << 63), 5]
    assert huffman_ids.encode(docs([]), TOKENIZER).count() == 0


def test_files_decode_by_themselves(docs, spark, tmp_path):
    rows = [(i, prose(i, 30)) for i in range(20)]
    path = f"file://{tmp_path}/tokens"
    out = {r["doc_id"]: r["ids_crc32"] for r in huffman_ids.encode(docs(rows), TOKENIZER, path=path).collect()}
    again = {r["id"]: r["ids_crc32"] for r in huffman_ids.read_segments(spark.newSession(), path).collect()}
    assert again == out and len(out) == 20
    # Another process, with nothing but the files.
    import subprocess
    import sys
    from pathlib import Path

    code = f"import zlib, numpy as np, pyarrow.parquet as pq; from siltstone.llm import huffman_ids as h\nl = np.frombuffer(zlib.decompress(pq.read_table({str(tmp_path)!r} + '/tokens/codes')['lengths'][0].as_py()), 'uint8')\nfor r in pq.read_table({str(tmp_path)!r} + '/tokens/segments').to_pylist():\n    ids = h.decode_ids(r['data'], np.cumsum(np.frombuffer(r['gaps'], '<u2'), dtype='int64'), r['n'], h.decode_table(l))\n    for i, x in zip(r['docs'], np.split(ids, np.cumsum(r['counts'])[:-1])): print(i, zlib.crc32(x.astype('<u4').tobytes()))"
    shown = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[2], capture_output=True, text=True, check=True).stdout
    assert dict(map(int, line.split()) for line in shown.splitlines()) == out


# ---------------------------------------------------------------- repeats


def brute_repeats(rows, n=50):
    out, seen = {}, {}
    for i, t in rows:
        raw = (t or "").encode()
        for k in range(len(raw) - n + 1):
            w = raw[k : k + n]
            seen[w] = min(seen.get(w, i), i)
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - n + 1):
            if seen[raw[k : k + n]] < i:
                gone[k : k + n] = True
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(raw) else 0
        out[i] = (len(raw), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(raw, "uint8")[~gone])).hexdigest())
    return out


def repeat_rows():
    base = prose(1, 80)
    rows = [(0, base), (1, base), (2, base[30:300] + prose(2, 10) + base[200:260]), (3, "x" * 49), (4, "x" * 49), (5, "x" * 200), (6, "x" * 120), (7, "ab" * 80), (8, "ba" * 80), (9, None), (10, "é" * 40), (11, "é" * 30 + "z")]
    common = prose(77, 30)
    rows += [(60 + i, prose(300 + i, 8) + " " + common + " " + prose(400 + i, 8)) for i in range(30)]
    return rows + [(20 + i, prose(100 + i, 20) + " " + base[i : i + 120] + " " + prose(200 + i, 20)) for i in range(30)]


@pytest.mark.parametrize("many, sample", [(20_000, 64), (3, 64), (20_000, 1)])
def test_suffix_arrays_against_brute_force(docs, monkeypatch, many, sample):
    monkeypatch.setattr(suffix_dedup, "MANY", many)  # 3: windows of common grams are dealt singly
    monkeypatch.setattr(suffix_dedup, "SAMPLE", sample)  # 1: the sample shows the common passage of 30 documents
    monkeypatch.setattr(suffix_dedup, "LEAST", 20)
    rows = repeat_rows()
    d = docs(rows)
    assert (len(suffix_dedup._common(d.select(F.col("doc_id").alias("id"), "text").where("text IS NOT NULL"), 50)) > 0) == (sample == 1)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.remove_repeats(d).collect()}
    assert got == brute_repeats(rows)


def test_two_stage_sort():
    rng = np.random.default_rng(3)
    for letters in (b"ab", b"aaab", b"abcdefgh"):
        t = np.concatenate([rng.choice(np.frombuffer(letters, "uint8"), 400), np.frombuffer(b"\xff\x00\x01" + b"\x00" * 80, "uint8")])
        wanted = np.zeros(len(t), bool)
        wanted[:350] = True
        sa = suffix_dedup.two_stage(t, wanted, 50)
        raw = t.tobytes()
        assert sorted(sa.tolist()) == list(range(350))
        keys = [raw[i : i + 50] for i in sa]
        assert keys == sorted(keys)


def pieces_by_key(rows, size):
    """Batches of the rows (key, doc, place, piece) in the order in which they are compared."""
    rows = sorted(rows, key=lambda r: (r[0], r[3], r[1]))
    for i in range(0, len(rows), size):
        columns = list(zip(*rows[i : i + size]))
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())], names=["key", "doc", "place", "piece"])


@pytest.mark.parametrize("size, most", [(1, 1 << 20), (7, 300), (1000, 1 << 20)])
def test_suffix_pieces_against_brute_force(monkeypatch, size, most):
    monkeypatch.setattr(suffix_dedup, "RUN_BYTES", most)
    rng, rows = np.random.default_rng(5), []
    for i in range(400):  # equal windows have equal keys, so each key has letters of its own
        key = int(rng.integers(8))
        n = int(rng.integers(24, 34))
        piece = bytes((65 + 2 * key + (rng.random(n) < 0.04)).astype("uint8"))
        rows.append((key, int(rng.integers(12)), int(suffix_dedup._pack(100 * i, n - 23, 9)), piece))
    first = {}
    for key, doc, _, piece in rows:
        for k in range(len(piece) - 23):
            first[piece[k : k + 24]] = min(doc, first.get(piece[k : k + 24], doc))
    want = {(doc, (place >> 30) + k) for _, doc, place, piece in rows for k in range(len(piece) - 23) if first[piece[k : k + 24]] < doc}
    got = []
    for b in suffix_dedup._compare(24)(pieces_by_key(rows, size)):
        for doc, place in zip(*(c.to_pylist() for c in b.columns)):
            got += [(doc, (place >> 30) + k) for k in range((place >> 24) & 63)]
    assert len(got) == len(set(got)) and set(got) == want


def test_suffix_memory_is_bounded(monkeypatch):
    """However many documents have one window, and however many pieces are asked for, a task holds few of them."""
    held, real = [], suffix_dedup.earliest

    def seen(segments, owners, length):
        held.append(sum(map(len, segments)))
        return real(segments, owners, length)

    monkeypatch.setattr(suffix_dedup, "earliest", seen)
    rows = [(1, i, int(suffix_dedup._pack(0, 1, 9)), b"w" * 50) for i in range(120_000)]
    rows += [(2, i, int(suffix_dedup._pack(0, 1, 9)), bytes([97 + i] * 50)) for i in range(9)]
    assert sum(b.num_rows for b in suffix_dedup._compare(50)(pieces_by_key(rows, 10_000))) == 119_999
    assert sum(held) < 1000

    text = "".join(map(chr, np.random.default_rng(1).integers(97, 123, 1000)))
    asks = [{"h": k, "place": int(suffix_dedup._pack(k, 30, zlib.crc32(text.encode()) & 0xFFFFFF)), "hot": k % 2 == 0} for k in range(900)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(100), pa.int64()), pa.array([text] * 100), pa.array([asks] * 100, pa.list_(pa.struct([("h", pa.int64()), ("place", pa.int64()), ("hot", pa.bool_())])))], names=["doc", "text", "asks"])
    sizes = [b.num_rows for b in suffix_dedup._segments(50)([batch])]
    assert sum(sizes) == 100 * (450 + 450 * 30) and max(sizes) < 11_000


def test_suffix_texts_go_to_python_in_small_batches(docs, spark, monkeypatch):
    name, seen, real = "spark.sql.execution.arrow.maxRecordsPerBatch", {}, suffix_dedup.Scratch.table
    monkeypatch.setattr(suffix_dedup.Scratch, "table", lambda self, df, label: seen.update({label: int(spark.conf.get(name))}) or real(self, df, label))
    usual = spark.conf.get(name)
    suffix_dedup.remove_repeats(docs(repeat_rows()))
    assert max(seen["shared"], seen["found"]) <= 1000 and spark.conf.get(name) == usual


def test_suffix_hard_rows(docs):
    out = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in suffix_dedup.remove_repeats(docs(HARD)).collect()}
    assert out[(8, 300_000)] == 0 and out[(1, 0)] == 0 and suffix_dedup.remove_repeats(docs(HARD)).count() == len(HARD)
    assert suffix_dedup.remove_repeats(docs([])).count() == 0


def brute_lines(rows, unit="line", least=100):
    """id -> places removed, by the rule as it is told: every line and every shortest run of sentences, one after the other."""
    import re

    said, places = {}, {}
    for i, t in rows:
        t, spans = t or "", []
        ends = sorted({m.end() for m in re.finditer("[.!?][ \t-\r]+|[。！？][ \t-\r]*|\n[ \t-\r]*", t)} | {len(t)}) if t else []
        begins = [0, *ends[:-1]] if ends else []
        solid = lambda a, b: len("".join(t[a:b].split()))
        for a in begins:
            run = next((b for b in ends if b > a and solid(a, b) >= least), None)
            if run and solid(a, min(e for e in ends if e > a)):
                spans.append((a, run))
        breaks = [b for a, b in zip(begins, ends) if b == len(t) or ("\n" in t[a:b] if unit == "line" else re.search("\n[ \t]*\n", t[a:b]))]
        spans += [(a, b) for a, b in zip([0, *breaks], breaks) if solid(a, b) >= least]
        places[i] = spans
        for a, b in spans:
            key = " ".join(t[a:b].lower().split())
            said[key] = min(said.get(key, (i, a)), (i, a))
    out = {}
    for i, t in rows:
        t = t or ""
        gone = {k for a, b in places[i] if said[" ".join(t[a:b].lower().split())] != (i, a) for k in range(a, b)}
        out[i] = ("".join(c for k, c in enumerate(t) if k not in gone), sorted(gone))
    return out


LONG = "This line is long enough, at a hundred letters or more without its blanks, to be taken for a repeat of another one somewhere."
PASSAGE = "First comes a sentence of middling length. Then there is one more of them to go with it! Is a third one needed to make a passage? A fourth one comes along as well, and it has a second part to it. The fifth of them ends it all, which makes it some fifty words. "


def line_rows():
    rows = [(3, f"{LONG}\nown three"), (1, f"own one\n{LONG.upper()}  \nshort\nshort"), (2, f"{LONG}\n{LONG}\nlast"), (4, None), (5, LONG), (6, ""), (7, "\n\n" + LONG)]
    rows += [(10, f"What stands before {PASSAGE}and what comes after."), (11, f"Quite another beginning\n{PASSAGE}is followed by others."), (12, "Wrapped in lines, " + PASSAGE.replace(" ", "\n") + "it is the same."), (13, PASSAGE[:80])]
    rows += [(20 + i, ". ".join(prose(i * k % 7, 4) for k in range(9)) + ("\n" if i % 2 else "\n\n") + LONG[: 20 * i]) for i in range(8)] + [(30, "the. " * 200), (31, "好。" * 120), (32, "好。" * 120)]
    return rows


@pytest.mark.parametrize("unit, least", [("line", 100), ("paragraph", 100), ("line", 1)])
def test_lines_against_brute_force(docs, unit, least):
    rows = line_rows()
    got = {r["doc_id"]: (r["text"] or "", sorted(k for s in r["spans"] for k in range(s["start"], s["end"]))) for r in line_dedup.dedup_units(docs(rows), unit, least).collect()}
    assert got == brute_lines(rows, unit, least)


def test_passages_inside_lines(docs):
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_units(docs(line_rows())).collect()}
    assert got[10] == dict(line_rows())[10] and "third one" not in got[11] and got[11].startswith("Quite another beginning") and got[13] == PASSAGE[:80]
    assert got[1] == f"own one\n{LONG.upper()}  \nshort\nshort" and got[2] == "last" and got[3] == "own three" and got[5] == "" and got[4] is None


def test_lines_hard_rows(docs, monkeypatch):
    from siltstone.llm import common

    d = docs(HARD).selectExpr("*", "'clash' AS t", "1 AS spans", "'x' AS digest", "2 AS id")
    assert line_dedup.dedup_units(d).count() == len(HARD) and line_dedup.dedup_units(docs([])).count() == 0
    rows = [(i, f"own {i}\n{LONG}\n{prose(i, 30)}") for i in range(12_000)]
    monkeypatch.setattr(common, "MOST_HOT", 3)  # the common line is joined by broadcast
    out = line_dedup.dedup_units(docs(rows))
    assert out.where("size(spans) = 1").count() == 11_999 and "BroadcastHashJoin" in out._jdf.queryExecution().toString()


# ---------------------------------------------------------------- near duplicates


def brute_components(rows, words, percent):
    fold = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    sets = []
    for _, t in rows:
        w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", fold(t)) if x]
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    of = list(range(len(rows)))

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                of[max(root(i), root(j))] = min(root(i), root(j))
    low = {}
    for k, (i, _) in enumerate(rows):
        low[root(k)] = min(low.get(root(k), i), i)
    return {i: (len(sets[k]), low[root(k)]) for k, (i, _) in enumerate(rows)}


def near_rows():
    rng = random.Random(5)
    rows = [(0, None), (1, ""), (2, "two words"), (3, "Two  WORDS"), (4, "one")]
    for f in range(6):
        base = prose(f, 90).split()
        for c in range(12):
            w = list(base)
            for _ in range(c):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(1000)}"
            rows.append((100 * (f + 1) + c, " ".join(w)))
    rows += [(900 + i, prose(50 + i, 40) + " a licence line that very many documents have in common") for i in range(40)]
    return rows


@pytest.mark.parametrize("words, percent, block", [(3, 85, 4096), (5, 80, 4096), (3, 85, 4)])
def test_near_duplicates_against_brute_force(docs, monkeypatch, words, percent, block):
    monkeypatch.setattr(minhash_join, "BLOCK_CLASSES", block)  # 4: lists are dealt in blocks
    rows = near_rows()
    want = brute_components(rows, words, percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_join.near_duplicates(docs(rows), words, percent).collect()}
    assert got == want


def test_merge_list_spans_components():
    rng = np.random.default_rng(2)
    base = np.sort(rng.choice(1 << 40, 100, replace=False)).astype("uint64")
    sets = [np.sort(np.concatenate([base[k:], rng.choice(1 << 41, k).astype("uint64")])) for k in (0, 2, 4, 60, 62)]
    sigs = minhash_join.signatures(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]))
    links = minhash_join.merge_list(sigs, sets, 1, 85)
    assert sorted(map(sorted, links)) == [[0, 1], [0, 2]]


def test_near_hard_rows(docs):
    rows = minhash_join.near_duplicates(docs(HARD), 3, 85).collect()
    assert len(rows) == len(HARD)
    by = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in rows}
    assert by[(1, 0)] == (1, True) and by[(6, 1)] == (5, False) and by[(5, 1)] == (5, True)
    assert minhash_join.near_duplicates(docs([])).count() == 0
    clash = docs(HARD).selectExpr("*", "1 AS n", "'x' AS cls", "2 AS id", "3 AS sig", "4 AS component_id")
    assert minhash_join.near_duplicates(clash, 3, 85).exceptAll(minhash_join.near_duplicates(docs(HARD), 3, 85)).count() == 0
    kept = sorted(r["doc_id"] or -1 for r in minhash_join.one_of_each(docs(HARD)).collect())
    assert kept == [-1, 1, 2, 3, 4, 5, 7, 8]


# ---------------------------------------------------------------- decontamination


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


ITEMS = [(1, "The quick brown fox jumps over the lazy dog today"), (2, "short item"), (10, "quick brown fox jumps over the lazy dog"), (4, None), (5, "!!")]


@pytest.mark.parametrize("most", [400_000, 1])
def test_decontamination(docs, spark, most):
    rows = [(1, "So: the QUICK brown-fox jumps over the lazy dog today, they say."), (2, "a short item, and a Short Item again"), (3, "quick brown fox jumps over the lazy cat"), (4, None), (5, "clean words only here and nothing else to see at all"), (6, "quick brown fox jumps over the lazy dog")]
    d, b = docs(rows), bench(spark, ITEMS)
    seen, hits = decontam.scan(d, b, 8, most_in_scan=most)
    got = {r["doc_id"]: (sorted(r["items"]), sorted(r["places"])) for r in hits.collect()}
    assert got == {1: (["1", "10"], list(range(2, 12))), 2: (["2"], [2, 3, 6, 7]), 6: (["1", "10"], list(range(1, 9)))}
    assert {r["doc_id"]: r["n_words"] for r in seen.collect()} == {1: 13, 2: 8, 3: 8, 4: 0, 5: 11, 6: 8}


def test_decontamination_report_and_removal(docs, spark):
    d, b = docs([(1, "x quick brown fox jumps over the lazy dog y"), (2, "fine"), (3, None)]), bench(spark, ITEMS)
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontam.report(d, b).collect()}
    assert got[1] == (8, 2, hashlib.sha256(b"1,10").hexdigest(), True) and got[2] == got[3] == (0, 0, hashlib.sha256(b"").hexdigest(), False)
    assert sorted(r["doc_id"] for r in decontam.remove(d, b).collect()) == [2, 3]
    assert {r["doc_id"]: r["text"] for r in decontam.remove(d, b, mode="spans").collect()} == {1: "x y", 2: "fine", 3: None}


def test_decontamination_hard_rows(docs, spark):
    assert decontam.report(docs(HARD), bench(spark, ITEMS)).count() == len(HARD)
    clash = docs(HARD).selectExpr("*", "1 AS h", "2 AS len", "'x' AS gram", "3 AS items", "4 AS at", "5 AS n_words", "6 AS item_id")
    assert decontam.report(clash, bench(spark, ITEMS)).exceptAll(decontam.report(docs(HARD), bench(spark, ITEMS))).count() == 0
    assert decontam.report(docs(HARD), bench(spark, [])).where("contaminated").count() == 0
    assert decontam.report(docs([]), bench(spark, ITEMS)).count() == 0


def test_decontamination_stays_in_the_jvm(docs, spark):
    plan = decontam.report(docs([(1, "a")]), bench(spark, ITEMS))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "ArrowEval", "MapInArrow"))
