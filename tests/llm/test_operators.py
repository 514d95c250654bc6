"""The operators against brute force on small tables, and on awkward rows."""

import collections
import hashlib
import math
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from compare import compare, connect, rows_of
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from loglattice.llm import common as c
from loglattice.llm import decontamination, exact_dedup, html_extraction, language_id, lm_scoring
from loglattice.llm import ngram_jaccard_join, packing, sharding, substring_dedup, url_filters
from loglattice.llm.registry import QUERIES, SQL

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def tuples(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def texts(folder):
    return duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(SQL))
def test_check_sql(spark, folder, name):
    df = QUERIES[name](spark, folder)
    with connect(folder) as con:
        cursor = con.execute(SQL[name])
        expected = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert compare(rows_of(df.columns, tuples(df)), expected) == ""


def test_all_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names


# packed arrays


def test_packing_of_arrays_round_trip():
    places = np.array([0, 3, 254, 255, 600, 1200])
    assert (c.positions(c.gaps(places)) == places).all()
    arrays = [places, np.array([], np.uint64), np.array([1.5])]
    assert all((a == b).all() for a, b in zip(arrays, c.unsqueezed(c.squeezed(arrays))))


# 1 extraction

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><p>Site, with a long line about itself.</p></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="ad">Buy, buy, buy. Now.</div><article><h1>Head &amp; tail</h1><p><b>First  para,<br>goes on.<p>Second&nbsp;one.
<ul><li>item one<li>item two</ul><form><p>Name?</p></form></article><div class="comments"><p>Nice, I like it. Very much.</p></div>
<footer>&copy; us</footer>"""


def test_extraction():
    assert html_extraction.main_text(PAGE) == "Head & tail\n\nFirst para, goes on.\n\nSecond one.\n\nitem one\n\nitem two"
    assert html_extraction.main_text(None) == html_extraction.main_text("") == html_extraction.main_text("<p></p>") == ""


def test_extraction_rows(spark):
    pages = spark.createDataFrame([(1, PAGE, "x"), (1, PAGE, "x"), (None, None, None)], "page_id long, html string, text string")
    found = html_extraction.extracted(pages)
    assert [len(r.text) == r.n_chars for r in found.collect()] == [True] * 3
    assert html_extraction.extracted(pages.limit(0)).count() == 0


LONG = "".join(f"<p>Sentence {i} of the article, with a second part; and an end. {'More words follow. ' * 6}</p>" for i in range(8))


@pytest.mark.parametrize(
    "page",
    [
        '<body class="has-sidebar">{}</body>',
        '<body class="no-sidebar"><div class="ad">Buy now.</div>{}</body>',
        '<body><article class="post comments comment-open">{}</article></body>',
        '<body><div id="page" class="site right-sidebar">{}</div></body>',
        '<body><div class="sidebar-layout"><article>{}</article></div><p>Imprint</p></body>',
        '<body><main class="search social">{}</main></body>',
        '<body><form id="aspnetForm"><div class="has-header">{}</div></form></body>',
    ],
)
def test_words_in_class_drop_no_page(page):
    found = html_extraction.main_text(page.format(LONG + '<div class="related">See also this.</div>'))
    assert "Sentence 0 " in found and "Sentence 7 " in found and "See also" not in found and "Buy" not in found


CELLS = "".join(f"<tr><td>cell {i:03}</td><td>cell {i + 6:03}</td></tr>" for i in range(6))
JUNK = '<nav>Home</nav><div class="x"><p>Tiny print.</p></div>'
PARTS = [
    (f"<article>{LONG}<div><table><tbody>{CELLS}</tbody></table></div></article>", ["cell 000", "cell 011"]),
    (f"<article>{LONG}<div><div><ul><li>one</li><li>two</li></ul></div></div></article>", ["one", "two"]),
    (f"<div><div>{LONG}<figure><div><figcaption>A caption</figcaption></div></figure></div></div>", ["A caption"]),
    (f"<h1>Short title</h1>{LONG}<ul><li>one</li><li>two</li></ul>", ["Short title", "one", "two"]),
    (f"<div><h2>Opened here</h2></div><div>{LONG}</div>", ["Opened here"]),
    (f"<h1>Short title</h1><table><tr><td>{CELLS}</table><div>{LONG}</div>", []),
]


@pytest.mark.parametrize("body, parts", PARTS)
def test_short_parts_of_the_article_stay(body, parts):
    found = html_extraction.main_text(f"<html><body>{JUNK}{body}{JUNK}</body></html>").split("\n\n")
    assert not set(parts) - set(found) and sum("Sentence" in x for x in found) == 8
    assert "Home" not in found and "Tiny print." not in found


# 2 url rules


def test_url_rules(spark):
    urls = [None, "no scheme", "http://COM/", "http://a.example.com/en/x?q", "http://www.example.com/en/x", "http://x.net/fr/",
            "http://x.net?/fr/", "https://notexample.com/en/", "http://my.spam-farm.org/", "http://x.net/fr/"]
    pages = spark.createDataFrame([(i, u, "own") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judged(pages, url_filters.SITE_RULES + url_filters.WORD_RULES).collect()}
    assert len(found) == len(urls)
    assert found[0] == found[1] == ("", "", None, "allow") and found[2] == ("com", "/", "com/", "allow")
    assert found[3][2:] == ("example.com/en/", "block") and found[4][2:] == ("www.example.com/en/", "allow")
    assert found[5][2:] == found[9][2:] == ("net/fr/", "block") and found[6][1:] == ("", None, "allow")
    assert found[7][2:] == ("com/", "allow") and found[8][2:] == (None, "block")
    with pytest.raises(ValueError):
        url_filters.indexed(spark, [url_filters.word_rule("block", "x")])


# 3 scoring


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((1, 1), (3, 10), (5000, 10**6), (700, 800)):
        values = np.sort(rng.choice(top, min(n, top), replace=False)).astype(np.uint64)
        coded = lm_scoring.EliasFano(lm_scoring.EliasFano.build(values, top))
        assert (coded.get(np.arange(len(values))) == values).all() and (coded.get(np.array([0])) == values[0]).all()
        asked = np.arange(min(top, 5000), dtype=np.uint64)
        expected = np.where(np.isin(asked, values), np.searchsorted(values, asked), -1)
        assert (coded.find(asked) == expected).all()
        assert (np.concatenate([coded.find(x) for x in np.array_split(asked, len(asked) // 7 + 1)]) == expected).all()


def check_scores(rows, pairs, trained):
    words = [((t or "").encode().lower().split() + [b""], trained(i)) for i, t in pairs]
    uni, two, kinds, context = (collections.Counter() for _ in range(4))
    for own, used in words:
        for before, word in zip([b" ", *own], own):
            if used:
                uni[word] += 1
                kinds[before] += not two[before, word]
                two[before, word] += 1
                context[before] += 1
    n, v = sum(uni.values()), len(uni)
    expected = collections.Counter()
    for (i, _), (own, _) in zip(pairs, words):
        base = sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in own)
        score = 0.0
        for before, word in zip([b" ", *own], own):
            p, total = (uni[word] + 1) / (n + v + 1), context[before]
            score += math.log10((max(two[before, word] - 0.75, 0) + 0.75 * kinds[before] * p) / total if total else p)
        expected[i, len(own), sum(uni[w] > 0 for w in own), n, round(base, 6)] += 1
        near = [r for r in rows if r[0] == i and r[1] == len(own) and abs(r[5] - score) <= 0.06 * len(own)]
        assert near, (i, score, [r for r in rows if r[0] == i], own)
    assert collections.Counter((*r[:4], round(r[4], 6)) for r in rows) == expected


def test_scores(spark, folder, texts):
    rows = [r[:1] + r[2:] for r in tuples(QUERIES["op3_lm_scoring"](spark, folder))]
    check_scores(rows, texts, lambda i: zlib.crc32(str(i).encode()) % 7 != 2)


def test_scores_awkward(awkward):
    rows = tuples(lm_scoring.scored(awkward, F.col("doc_id") > 1))
    check_scores(rows, [(r.doc_id, r.text) for r in awkward.collect()], lambda i: i is not None and i > 1)
    assert lm_scoring.scored(awkward.limit(0), F.lit(True)).count() == 0
    assert lm_scoring.scored(awkward, F.lit(None).cast("boolean")).count() == awkward.count()


def test_scores_send_only_frequent_tokens_to_the_driver(docs_of, monkeypatch):
    rng, each = np.random.default_rng(3), 500
    texts = [" ".join(f"rare{i}x{j} often{j % 3}" for j in range(each)) for i in range(20)]  # 10,000 rare words
    docs, sent, kind = docs_of(list(enumerate(texts))), [], type(docs_of([(1, "")]))

    def collect(self, real=kind.collect):
        rows = real(self)
        sent.extend(len(c.unsqueezed(x)[-1]) for r in rows for x in r if isinstance(x, (bytes, bytearray)))
        return rows

    monkeypatch.setattr(kind, "collect", collect)
    found = lm_scoring.scored(docs, F.lit(True))
    monkeypatch.undo()
    assert 3 <= sum(sent) <= 4  # the three frequent words, and the start if it is
    rows = tuples(found.where(F.col("doc_id").isin(rng.integers(0, 20, 2).tolist())))
    assert rows and all(r[1:4] == (2 * each + 1, 2 * each + 1, 20 * (2 * each + 1)) for r in rows)


# 4 packing


def check_pieces(rows, pairs, window=2048):
    inner = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = collections.defaultdict(list)
    for i, t in pairs:
        ids[i].append(inner.encode(t or "", add_special_tokens=False).ids + [1])
    sequences, total = collections.defaultdict(list), collections.Counter()
    for doc, start, length, crc, tokens, sequence, offset, *_ in rows:
        raws = [np.array(x[start : start + length], "<u4").tobytes() for x in ids[doc] if len(x) == tokens]
        assert crc in {zlib.crc32(x) for x in raws}
        sequences[sequence].append((offset, length))
        total[doc] += length
    assert total == {i: sum(map(len, x)) for i, x in ids.items()}
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= window
    sizes = sorted(sum(n for _, n in x) for x in sequences.values())
    assert all(x == window for x in sizes[1:])


def test_pieces(spark, folder, texts):
    check_pieces(tuples(QUERIES["op4_packing"](spark, folder)), texts)


def test_pieces_awkward(awkward):
    found = packing.packed(awkward, RANKS, public_tokenizers.PATTERN, window=64)
    check_pieces(tuples(found), [(r.doc_id, r.text) for r in awkward.collect()], 64)
    assert packing.packed(awkward.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_mixture_carries_deficits():
    mixture = packing.Mixture([500, 3, 70, 9000], [5, 1, 1, 1.5], 64)
    before = mixture.served(0)
    for k in range(1, 151):
        now = mixture.served(k)
        assert (now >= before).all() and now.sum() == min(64 * k, mixture.total)
        before = now
    even = packing.Mixture([4000, 4000, 2000], [4000, 4000, 2000], 50)
    assert all(abs(even.served(k) - 50 * k * np.array([0.4, 0.4, 0.2])).max() <= 1 for k in range(200))


# 5 join


def brute_components(pairs):
    sets = {}
    for i, t in pairs:
        w = (t or "").encode().lower().split()
        k = min(5, len(w))
        sets.setdefault(i, []).append({tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if w else set())
    root = {i: i for i in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    ids = sorted(sets, key=lambda x: (x is None, x or 0))
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((find(a), find(b)), key=lambda v: (v is None, v or 0))
                root[y] = x
    return sorted(((i, len(s), find(i)) for i in sets for s in sets[i]), key=str)


def test_join(spark, folder, texts):
    assert sorted(tuples(QUERIES["op5_ngram_jaccard_join"](spark, folder)), key=str) == brute_components(texts)


def test_join_awkward(awkward, docs_of):
    assert ngram_jaccard_join.grouped(awkward.limit(0)).count() == 0
    found = tuples(ngram_jaccard_join.grouped(awkward.where("doc_id IS NOT NULL")))
    assert sorted(found, key=str) == brute_components([(r.doc_id, r.text) for r in awkward.collect() if r.doc_id])
    rng = np.random.default_rng(5)  # edited copies around the threshold, with a passage that all share
    passage, pairs = [f"p{i}" for i in range(30)], []
    origin = [f"w{i}" for i in range(90)]
    for i in range(120):
        own = origin.copy() if i % 2 else [f"d{i}w{j}" for j in range(90)]
        for j in rng.choice(90, rng.integers(0, 9), replace=False):
            own[j] = f"e{i}x{j}"
        pairs.append((i, " ".join(own + passage)))
    assert sorted(tuples(ngram_jaccard_join.grouped(docs_of(pairs))), key=str) == brute_components(pairs)


# 6 spans


def brute_spans(pairs, n=13):
    order = lambda i: (1 << 63) - 1 if i is None else i
    first, words = {}, [(i, (t or "").encode().split()) for i, t in pairs]
    for i, w in words:
        for a in range(len(w) - n + 1):
            key = tuple(w[a : a + n])
            first[key] = min(first.get(key, order(i)), order(i))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for a in range(len(w) - n + 1):
            if first[tuple(w[a : a + n])] < order(i):
                gone[a : a + n] = [True] * n
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_spans(spark, folder, texts, awkward):
    assert sorted(tuples(QUERIES["op6_substring_dedup"](spark, folder)), key=str) == brute_spans(texts)
    found = substring_dedup.deduplicated(awkward)
    rows = tuples(found.select("doc_id", "n_words", "n_removed", "kept_sha256"))
    assert sorted(rows, key=str) == brute_spans([(r.doc_id, r.text) for r in awkward.collect()])
    assert substring_dedup.deduplicated(awkward.limit(0)).count() == 0
    spans = {r.doc_id: r.factors for r in found.collect()}
    assert [(s.start, s.end, s.source_id, s.source_start) for s in spans[8]] == [(0, 16, 1, 0)]


def test_places_of_bits():
    rng = np.random.default_rng(3)
    for share in (0.02, 0.5, 0.98, 1.0):
        bits = (rng.random((40, 512)) < share).astype(np.uint8)
        bits[:, 511] = 1
        pieces = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        rank = rng.integers(1, bits.sum(axis=1) + 1)
        expected = [np.flatnonzero(b)[r - 1] for b, r in zip(bits, rank)]
        assert lm_scoring.place_of(pieces, rank).tolist() == expected


# 7 language


def test_language(spark, folder):
    lang = {r.doc_id: r.lang for r in c.table(spark, folder, "documents").collect()}
    held = [r for r in QUERIES["op7_language_id"](spark, folder).collect() if r.held_out]
    assert held and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in held)


def test_language_awkward(spark, docs_of):
    texts = [("en", "the house and the garden"), ("de", "das haus und der garten"), ("fr", "la maison et le jardin")]
    model = language_id.fit([(v, language_id.features(t)) for v, t in texts])
    docs = docs_of([(1, None), (2, ""), (3, "12 !?"), (4, "the garden"), (4, "the garden")]).withColumn("score", F.lit("x"))
    found = [(r.doc_id, r.lang_pred) for r in language_id.identified(docs, model).orderBy("doc_id").collect()]
    assert found == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en")]
    assert {r.lang_pred for r in language_id.identified(docs, language_id.fit([])).collect()} == {"und"}
    assert language_id.identified(docs.limit(0), model).count() == 0 and language_id.trained(docs.limit(0)).families == []


def test_language_pairs_in_a_family():
    rng = np.random.default_rng(2)
    letters = {"da": "abcdefg", "no": "abcdehi", "sv": "abcjkeh", "nl": "ajklmno"}
    made = {v: ["".join(rng.choice(list(x + " "), 80)) for _ in range(30)] for v, x in letters.items()}

    def fitted(*names):
        return language_id.fit([(v, language_id.features(t)) for v in names for t in made[v]])

    model = fitted("da", "nl", "no", "sv")
    assert len(model.weights["germanic"]) == 6  # a machine per pair, which no third language moves
    assert np.array_equal(model.weights["germanic"][1], fitted("da", "no").weights["germanic"][0])
    found = [(v, *model.predict(t)) for v in made for t in made[v]]
    assert sum(v == p for v, p, _ in found) >= 0.95 * len(found) and all(0 <= s <= 1 for _, _, s in found)


def test_language_sample_has_no_copies(spark):
    letters = str.maketrans("0123456789", "abcdefghij")
    rows = [(f"word {i} of this".translate(letters), "en") for i in range(600)] + [(x, "en") for x in ["often copied", "copied too"] for _ in range(4000)]
    rows += [(f"ein Text {i}".translate(letters), "de") for i in range(30)]
    found = language_id.sample(spark.createDataFrame(rows, "text string, lang string"))
    assert len({(v, x.tobytes()) for v, x in found}) == len(found)
    assert collections.Counter(v for v, _ in found) == {"en": language_id.SAMPLE_EACH, "de": 30}


def test_language_parts_count_each_run_once(monkeypatch):
    text = "Über 12 Straßen, und noch mehr Wörter! " * 9
    whole = language_id.features(text)
    for part in (1, 2, 3, 7, 64, 100):
        monkeypatch.setattr(language_id, "PART", part)
        assert np.array_equal(language_id.features(text), whole)


def test_language_sample_of_many_languages(spark):
    names = [f"l{i:02d}" for i in range(50)]
    rows = [(f"text {chr(97 + i % 26)}{chr(97 + j)} {n}", n) for i, n in enumerate(names) for j in range(8)]
    found = language_id.sample(spark.createDataFrame(rows, "text string, lang string"))
    assert collections.Counter(v for v, _ in found) == dict.fromkeys(names, 8)


# 8 copies


def test_copies_awkward(awkward):
    found = collections.Counter(tuple(r)[:4] for r in exact_dedup.copies(awkward).collect())
    assert found[10, 10, 5, True] == 1 and found[2, 10, 5, False] == 2 and found[None, 10, 5, False] == 1
    assert found[4, 4, 2, True] == 1 and found[3, 4, 2, False] == 1 and sum(found.values()) == awkward.count()
    repeated = awkward.where("doc_id = 2")
    assert sorted(r.kept for r in exact_dedup.copies(repeated).collect()) == [False, True]
    assert exact_dedup.copies(awkward.limit(0)).count() == 0


def test_doubtful_digests_are_told_apart(spark):
    rows = [(7, 1, "x", b"a" * 16, b"p" * 12), (8, 2, "y", b"a" * 16, b"q" * 12), (9, 3, "z", b"b" * 16, b"r" * 12), (10, 4, "", b"", b"")]
    found = spark.createDataFrame(rows, "row long, doc_id long, text_sha256 string, names binary, proofs binary")
    ids = {r.doc_id: bytes(r.ids) for r in exact_dedup.verified(found).collect()}
    assert ids[1] != ids[2] and ids[3] == b"b" * 16 and ids[4] == b""
    sure = {r.doc_id: bytes(r.ids) for r in exact_dedup.verified(found.where("doc_id <> 2")).collect()}
    assert sure == {1: b"a" * 16, 3: b"b" * 16, 4: b""}


def test_copies_of_long_texts(docs_of):
    rng = np.random.default_rng(5)
    long = rng.integers(97, 123, 6_000_000, dtype=np.uint8).tobytes().decode()
    found = exact_dedup.copies(docs_of([(1, long), (2, long.upper()), (3, long + "x"), (4, "x" * 3_000_000)])).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in found} == {(1, 2, 2), (2, 2, 2), (3, 3, 1), (4, 4, 1)}


# 9 shards


def test_shards(spark, folder, awkward, texts):
    rows = QUERIES["op9_sharding"](spark, folder).collect()
    size, slots = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    expected = {i: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts}
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == expected and sorted(size) == list(range(40))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(size.values()) - min(size.values()) <= 2 * max(s for s, _ in expected.values())
    odd = sharding.sharded(awkward, 3).collect()
    assert len(odd) == awkward.count() and sharding.sharded(awkward.limit(0), 3).count() == 0


def test_shards_part_a_heavy_group(docs_of):
    docs = docs_of([(i, "same words " * 20 if i % 3 else f"text {i} " * 30) for i in range(600)])
    size = collections.Counter()
    for r in sharding.sharded(docs, 8).collect():
        size[r.shard] += r.size
    assert max(size.values()) <= 1.05 * min(size.values())


# 10 decontamination


@pytest.mark.parametrize("block", [3, 1 << 20])
def test_words_are_hashed_alike_in_any_block(monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", block)
    odd = ["", " ", "_a_b", "e\u0301x \u0130 \u03a3\u0391\u03a3", "\ud800ab", "x" * 50 + " y", "\u65e5\u672c 12,5 Stra\u00dfe"]
    by_word = {}
    for text in [None, *odd, " ".join(odd)]:
        found = decontamination.WORD.findall((text or "").lower())
        codes = decontamination.word_codes(text).tolist()
        assert len(codes) == len(found)
        assert all(by_word.setdefault(w, x) == x for w, x in zip(found, codes))
    assert len(set(by_word.values())) == len(by_word)


def test_leaks(spark, folder, texts):
    found = {(r.doc_id, r.item_id) for r in QUERIES["op10_benchmark_decontamination"](spark, folder).collect()}
    items = duckdb.sql(f"SELECT item_id, text FROM '{folder}/benchmark.parquet'").fetchall()
    assert {(d, i) for d, t in texts for i, x in items if x in (t or "")} <= found
    held = {i: set(zip(w, w[1:], w[2:])) for i, w in ((i, x.lower().split()) for i, x in items)}
    for d, i in found:  # what is caught shares most of the item
        w = dict(texts)[d].lower().split()
        assert len(held[i] & set(zip(w, w[1:], w[2:]))) >= 0.4 * len(held[i])


def test_leaks_awkward(spark, awkward, docs_of):
    item = "Every quick brown fox jumps over twelve lazy dogs while seven wizards box at night."
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, item)], "item_id long, text string")
    edited = item.lower().replace("brown ", "").replace("twelve", "many").replace("box", "box loudly").rstrip(".")
    docs = docs_of([(1, "x y z " * 50 + edited + " q" * 40), (2, item), (3, "Every quick brown fox is red."), (4, None), (2, item)])
    found = decontamination.matches(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 1), (1, None), (2, 1), (2, None)} and len(found) == 4
    assert sorted(r.doc_id for r in decontamination.clean(docs, items).collect()) == [3, 4]
    assert decontamination.matches(docs.limit(0), items).count() == decontamination.matches(docs, items.limit(0)).count() == 0
    assert decontamination.clean(awkward, items).count() == awkward.count()


def brute_leaks(docs, items, n, least):
    """Smith-Waterman in plain Python over the whole text of every pair that shares an n-gram."""
    words = {k: decontamination.WORD.findall((x or "").lower()) for k, x in [*docs.items(), *items.items()]}
    grams = {k: {tuple(w[i : i + n]) for i in range(max(0, len(w) - n + 1))} or {tuple(w)} for k, w in words.items()}
    out = {}
    for d in docs:
        for i in items:
            if not grams[d] & grams[i]:
                continue
            row, best = [0] * (len(words[d]) + 1), 0
            for x in words[i]:
                new = [0]
                for j, y in enumerate(words[d]):
                    new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
                row, best = new, max(best, *new)
            if best / (2 * len(words[i])) >= least:
                out[d, i] = best / (2 * len(words[i]))
    return out


def test_leaks_of_an_item_that_leaked_often(docs_of, spark):
    item = [f"w{i}" for i in range(20)]
    edited = [x if i not in (5, 12) else "other" for i, x in enumerate(item)]
    loose = [x for i, w in enumerate(item) for x in ([w, "added"] if i % 4 == 3 else [w])]
    half = [*item[:11], *("z%d" % i for i in range(30)), *item[4:8]]
    texts = {i: " ".join(item) for i in range(300)}  # over 1 % of the rows, and over 100
    texts |= {300: " ".join(edited), 301: "a b c " * 30 + " ".join(loose) + " d e" * 30, 302: " ".join(half), 303: " ".join(item[:6])}
    texts |= {400 + i: f"filler text number {i} w1 w2 w3 w4" for i in range(1000)}
    items = {-1: " ".join(item)}
    rows = spark.createDataFrame([(-1, items[-1])], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.score for r in decontamination.matches(docs_of(list(texts.items())), rows).collect()}
    assert found == brute_leaks(texts, items, decontamination.N, decontamination.LEAST)
    assert found[300, -1] == 0.85 and (302, -1) in found and (303, -1) not in found


def test_leaks_equal_brute_force():
    rng = np.random.default_rng(5)
    items = {-1 - i: " ".join(map(str, rng.integers(0, 12, rng.integers(1, 25)))) for i in range(12)}
    texts = {i: " ".join(map(str, rng.integers(0, 14, rng.integers(0, 120)))) for i in range(60)}
    for least in (0.3, 0.5, 0.8):
        own = decontamination.Items(list(items.items()), 3)
        seen = np.unpackbits(own.filter).astype(bool)
        found = {(d, own.ids[i]): s for d, t in texts.items() for i, s in own.leaked(decontamination.word_codes(t), seen, least)}
        assert found and found == brute_leaks(texts, items, 3, least)


# pipeline


def test_pipeline(spark, folder, texts):
    docs, seen = c.table(spark, folder, "documents"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = c.stored(stage(spark, docs, folder), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})
    letters = {i: t for i, t in texts if t and any(ch.isalpha() for ch in t)}
    assert seen[0] == letters
    groups = collections.defaultdict(list)
    for i, t in letters.items():
        groups[t.translate({a: a + 32 for a in range(65, 91)})].append(i)
    assert set(seen[1]) == {max(x) for x in groups.values()}
    assert set(seen[2]) == {i for i, _, root in brute_components(sorted(seen[1].items())) if i == root}
    items = duckdb.sql(f"SELECT text FROM '{folder}/benchmark.parquet'").fetchall()
    assert not [i for i, t in seen[3].items() if any(x in t for (x,) in items)]
    check_pieces(tuples(corpus_pipeline.run(spark, folder)), sorted(seen[3].items()))
