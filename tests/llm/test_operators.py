"""Edge cases of the corpus operators: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lattica.llm import bpe, common, exact_dedup, mixing, packing
from lattica.llm.exact_dedup import drop_exact_copies, exact_groups
from lattica.llm.html_extraction import extract, main_texts
from lattica.llm.line_dedup import drop_boilerplate
from lattica.llm.mixing import mix, mixed_documents
from lattica.llm.packing import pack
from lattica.llm.quality_classifier import isotonic, keep_good, quality_scores
from lattica.llm.quality_rules import POLICIES, RULES, ablations, apply_policy, ledger
from lattica.llm.queries import ORACLE_SQL, QUERIES
from lattica.llm.token_counts import token_counts
from lattica.llm.toxicity import toxicity_scores
from tests.llm.helpers import words_of
from tests.oracle import compare

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, _gone string"
TEXTS = [
    None, "", " \t\n", "one", "The Cat sat.\nThe Cat sat.\n\nOn the mat!", "the cat sat.\nthe cat sat.\n\non the mat!", "a b c d e " * 40, "long " * 60_000, "x" * 30_000,
    "don't we'll\x85 　日本語 👩‍👩‍👧 é ½ <|endoftext|> tail", "menu\nmenu\nstory one", "menu\nstory two", "menu\r\nstory three", "STUPID idiot moron scum"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(100 + i, t, "en", "s" if i % 3 else None, 0, "clash", "w") for i, t in enumerate(TEXTS)] + [(100, None, None, None, None, None, None), (103, "one", "en", "s", 3, "c", "w"), (None, "one", "en", "s", 3, "c", "w"), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(100 + i, int(i not in (1, 2, 6)), int(i == 13)) for i in range(len(TEXTS))] + [(104, None, None), (104, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")


def lowered(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def test_exact_groups(docs, none):
    got = exact_groups(docs).collect()
    assert len(got) == docs.count()
    groups = defaultdict(list)
    for r in docs.collect():
        groups[hashlib.sha256(lowered(r.text).encode()).hexdigest()].append(r.doc_id)
    for r in got:
        ids = groups[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(dict.fromkeys(groups, 1))
    assert exact_groups(none).count() == 0


def test_drop_exact_copies(docs, none):
    got = drop_exact_copies(docs)
    assert got.columns == docs.columns
    best = {}
    for r in docs.collect():
        k = lowered(r.text)
        best[k] = max(best.get(k, -1), -1 if r.doc_id is None else r.doc_id)
    assert Counter((lowered(r.text), r.doc_id) for r in got.collect()) == Counter({(k, v): 1 for k, v in best.items()})
    assert drop_exact_copies(none).count() == 0


@pytest.mark.parametrize(("fan_in", "held"), [(32, 1 << 23), (2, 64)])
def test_repeated_slots_match_plain_counting(spark, monkeypatch, fan_in, held):
    """Sparse and dense slots, many tasks merged a few at a time."""
    monkeypatch.setattr(exact_dedup, "FAN_IN", fan_in)
    monkeypatch.setattr(exact_dedup, "HELD_SLOTS", held)
    monkeypatch.setattr(exact_dedup, "RANGE_BITS", 1 << 10)
    for rows, bits in ((60, 1 << 13), (3000, 1 << 12)):
        digests = [hashlib.sha256(str(i % (rows * 3 // 4)).encode()).digest() for i in range(rows)]
        n = Counter(int(x) for s in exact_dedup._slots(pa.array(digests, pa.binary()), bits) for x in s)
        table = spark.createDataFrame([(bytearray(x),) for x in digests], "_digest binary").repartition(9)
        for least in (1, 2):
            got = np.unpackbits(np.frombuffer(zlib.decompress(exact_dedup.repeated_slots(table, bits, least)), np.uint8))
            assert set(np.flatnonzero(got).tolist()) == {k for k, v in n.items() if v >= least}


def test_token_counts_match_library(docs, none):
    library = Tokenizer.from_file(BYTE)
    want = Counter((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts(docs, BYTE).collect()) == want
    assert token_counts(none, BYTE).count() == 0


def test_packing_matches_library_and_fills_sequences(docs, none):
    library = Tokenizer.from_file(WORD)
    got = pack(docs, WORD, 256).collect()
    want = Counter()
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [0]
        for i in range(0, len(ids), 256):
            part = ids[i:i + 256]
            want[(r.doc_id, i // 256, i, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 256
    assert pack(none, WORD).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_dominance_keeps_the_optimum(seed):
    """The reduced instance plus the fixed bins needs as few bins as the whole one, by exhaustive search."""
    rng = random.Random(seed)
    limit = 12
    sizes = [rng.randint(1, 12) for _ in range(9)]

    def best(items):
        items = sorted(items, reverse=True)
        least = [len(items)]

        def go(i, bins):
            if len(bins) >= least[0]:
                return
            if i == len(items):
                least[0] = len(bins)
                return
            for j in {b: k for k, b in enumerate(bins)}.values():
                if bins[j] + items[i] <= limit:
                    go(i + 1, [*bins[:j], bins[j] + items[i], *bins[j + 1:]])
            go(i + 1, [*bins, items[i]])

        go(0, [])
        return least[0] if items else 0

    counts = dict(Counter(sizes))
    fixed = sum(n for _, n in packing.reduce_instance(counts, limit))
    left = [x for x, n in counts.items() for _ in range(n)]
    assert fixed + best(left) == best(sizes)
    plan = packing.plan(dict(Counter(sizes)), limit)
    assert len(plan) and plan[:, 3].max() + 1 >= best(sizes)


def test_rank_synchronous_merging_of_odd_texts():
    model = bpe.load(BYTE)
    assert model.merger.merge(model.inside[:0], model.inside[:0])[0].size == 0


def rule_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    n = Counter(windows)
    covered = {j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(docs, none):
    led = apply_policy(ledger(docs), "v1")
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in led.collect())
    assert got == Counter((r.doc_id, *rule_counts(r.text)) for r in docs.collect())
    for r in led.collect():
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)
    bits = {name: 1 << i for i, (name, _) in enumerate(RULES)}
    failed = [r.failed for r in led.collect()]
    want = {(p, r): (sum(f & bits[r] != 0 for f in failed), sum(f & sum(bits[x] for x in POLICIES[p]) == bits[r] for f in failed)) for p in ("v1", "v2") for r in POLICIES[p]}
    assert {(r.policy, r.rule): (r.fails, r.only_this) for r in ablations(led, ["v1", "v2"]).collect()} == want
    assert ledger(none).count() == 0
    assert not any(re.search("Python|Arrow|Pandas", x) for x in led._jdf.queryExecution().executedPlan().toString().splitlines())


@pytest.mark.parametrize("most", [1 << 21, 0])
def test_line_dedup(docs, none, most):
    got = drop_boilerplate(docs, "source", min_pages=2, ratio=0.1, most=most)
    assert set(docs.columns) <= set(got.columns)
    rows = docs.collect()
    pages, seen = Counter(r.source for r in rows), defaultdict(Counter)
    for r in rows:
        seen[r.source].update({x.strip(" \t\r") for x in (r.text or "").split("\n")} - {""})
    bad = {(s, k) for s, c in seen.items() for k, n in c.items() if n >= 2 and n > 0.1 * pages[s]}
    want = Counter((r.doc_id, "\n".join(x for x in (r.text or "").split("\n") if (r.source, x.strip(" \t\r")) not in bad)) for r in rows)
    assert Counter((r.doc_id, r.text) for r in got.collect()) == want and any(k == "menu" for _, k in bad)
    assert drop_boilerplate(none, "source", most=most).count() == 0


def test_scores_of_odd_rows(docs, labels, none):
    for f in (quality_scores, toxicity_scores):
        got = f(docs, labels).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 and not math.isnan(r.score) for r in got)
        for r in got:
            modulo, rest = (5, 0) if f is quality_scores else (3, 1)
            assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % modulo == rest)
        assert f(none, labels).count() == 0
        assert f(docs, labels.limit(0)).count() == docs.count()
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= docs.count()


def test_isotonic_is_monotone():
    curve = isotonic(np.array([4.0, 0, 4, 4, 0, 4]), np.array([1.0, 0, 0, 3, 0, 2]))
    assert (np.diff(curve) >= 0).all()


def test_mixing(docs, labels, none):
    got = mix(docs, labels).collect()
    assert len(got) == docs.count() and all(r.rate >= 0 and abs(r.p_clean + r.p_toxic + r.p_junk - 1) < 1e-6 for r in got)
    assert mix(none, labels).count() == 0
    out = mixed_documents(docs, labels)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)
    assert mixed_documents(none, labels).count() == 0 and keep_good(none, labels).count() == 0


def test_mixing_delivers_its_targets(spark):
    """Fitted and delivered shares against the targets, and the rates against plain projected gradient on the same posteriors."""
    d = "/root/testdata/sf0.01"
    mixed = mix(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")).cache()
    rows = mixed.collect()
    p, n, rate, copies = (np.array([x for x in col]) for col in zip(*[((r.p_clean, r.p_toxic, r.p_junk), r.n_tokens, r.rate, r.copies) for r in rows], strict=True))
    for r in mixing.shares(mixed).collect():
        k = mixing.DOMAINS.index(r.domain)
        assert r.target == pytest.approx(mixing.TARGETS[r.domain]) and r.fitted == pytest.approx((p[:, k] * n * rate).sum() / (n * rate).sum())
        assert abs(r.fitted - r.target) < 2e-3 and abs(r.delivered - r.target) < 2e-2 and r.delivered == pytest.approx((p[:, k] * n * copies).sum() / (n * copies).sum())
    want = np.array([mixing.TARGETS[x] for x in mixing.DOMAINS])
    x, size = np.ones(len(n)), n / n.sum()
    for _ in range(20_000):  # plain steps on the squared distance
        x = np.clip(x - p @ (p.T @ (size * x) - want), 0, mixing.MAX_RATE)
    assert np.abs(p.T @ (size * x) - want).max() < 2e-3 and np.abs(p.T @ (size * rate) - want).max() < 2e-3
    assert (rate >= 0).all() and (rate <= mixing.MAX_RATE).all() and (np.abs(copies - rate) < 1.5).all()


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a = "<p>no</p>";</script></head><body><header class="site-header"><a href="/">Home</a></header>
<nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">We use cookies.</div><aside>Side</aside><div class="ad">Buy now, please.</div>
<article><h1>Head &amp; title</h1><p>First   paragraph,
with <b>bold</b> and <a href="x">a link</a>.</p><p>Second &lt;one&gt;.<br>Next line.<ul><li>item one</li><li>item two</li></ul><form><input><button>Send</button></form></article>
<section id="comments"><p>Nice article, thanks!</p></section><footer>&copy; all</footer></body></html>"""


def test_html_extraction(spark):
    assert extract(PAGE) == "Head & title\n\nFirst paragraph, with bold and a link.\n\nSecond <one>. Next line.\n\nitem one\n\nitem two"
    plain = "<html><body><div id=menu><a href=1>One</a> <a href=2>Two</a></div><div class=content><p>" + "A sentence, with words. " * 10 + "</p><p>" + "More of it, as before. " * 8 + "</p></div><div class=footer>Imprint</div></body></html>"
    assert extract(plain) == ("A sentence, with words. " * 10).strip() + "\n\n" + ("More of it, as before. " * 8).strip()
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (3, "v", "", "x"), (4, "w", "<p>" + "long text. " * 20_000, "x"), (5, "w", "<b>unclosed <i>text", "x"), (6, "q", "<", "x")], "page_id long, url string, html string, text string")
    got = {(r.page_id, r.n_chars) for r in main_texts(pages).collect()}
    assert {(2, 0), (3, 0), (4, 219_999)} <= got and main_texts(pages).count() == 7 and main_texts(pages.limit(0)).count() == 0


def test_html_ratios_decide_inside_the_article():
    long = "A sentence, with words. " * 10
    def page(x):
        return f"<article><h1>Title</h1><p>{long}</p>{x}<p>{long}</p></article>"

    def kept(x):
        return extract(page(x)).split("\n\n")[1:-1]

    for noise in ('<div class="box-x">Read this next</div>', "<div>Tap to zoom</div>", '<div class="voice"><p>So true, thanks!</p></div>'):
        assert kept(noise) == [long.strip()], noise
    assert kept("<p>Yes.</p><ul><li>one</li></ul><table><tr><td>1</td></tr></table>") == [long.strip(), "Yes.", "one", "1"]
    assert kept('<p class="lead">Short, but of the column.</p>') == [long.strip(), "Short, but of the column."]
    assert kept("<h2>Part</h2><h3>Of it</h3>") == [long.strip(), "Part", "Of it"]
    assert kept('<h2>Voices</h2><div class="voice"><p>So true!</p></div><h2>Part</h2>') == [long.strip(), "Part"]
    assert extract("<article><h1>Only this</h1></article>") == "Only this"


def test_html_ratios_decide_without_lists_and_articles(monkeypatch):
    """What no list of names knows: links, short notices and foreign columns go by the ratios of the whole page."""
    from lattica.llm import html_extraction as h

    long = ("A sentence, with words, that goes on. " * 12).strip()
    noise = '<div class=x1><a href=1>One</a> <a href=2>Two</a></div>', '<div class=x2>Call now</div>', '<div class=x3><p>So true!</p></div>'
    want = f"{long}\n\n{long}\n\nOf the column."
    body = f"<p>{long}</p><p>{long}</p><p>Of the column.</p>"
    assert extract(f"<body>{noise[0]}<div class=text>{body}</div></body>") == want
    assert extract(f"<body>{''.join(noise)}<article>{body}</article><div class=x4><p>{long[:200]}</p></div></body>") == want
    assert extract('<article><p class="meta-analysis">' + long + "</p><figure><figcaption>A caption.</figcaption></figure><p>" + long + "</p></article>").count("\n\n") in (1, 2)
    monkeypatch.setattr(h, "BOILER", frozenset())
    monkeypatch.setattr(h, "_boiler", lambda token: False)
    page = f"<body><nav><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></nav><div class=ad>Buy now</div><article>{body}</article><footer>All ours</footer></body>"
    assert extract(page) == want
    monkeypatch.setattr(h, "SHARE", 0)
    assert extract(page) != want


def test_html_hidden_and_boilerplate_names_are_whole():
    text = ("A sentence, with words. " * 10).strip()
    for x in ('style="overflow:hidden"', 'title="hidden gems"', 'class="content no-sidebar"', 'class="has-sidebar"', 'class="page_with-sidebar"', 'class="post tag-news"', 'data-menu="hidden" class=text', 'data-class="sidebar"', 'style="backface-visibility:hidden"'):
        for page in (f"<body><div {x}><article><p>{text}</p></article></div></body>", f"<body><div {x}><p>{text}</p></div></body>"):
            assert extract(page) == text, page
    for x in ("hidden", 'hidden=""', "class=sidebar", "class='x Sidebar y'", 'class="cookie-notice"', 'class="main-nav"', 'id="comments"', 'role="search"', 'style="color:red; display : none"', "style='visibility:hidden'"):
        assert extract(f"<body><div><p>{text}</p></div><div {x}><p>B. {text}</p></div></body>") == text, x
    for name in ("body", "html", "article", "main"):
        for x in ("hidden", "style='visibility:hidden'", "class=sidebar"):
            assert extract(f"<{name} {x}><p>{text}</p></{name}>") == text


def test_texts_larger_than_a_block(spark):
    """One text of over a megabyte through every operator on documents, beside short ones."""
    from lattica.llm.jaccard_join import jaccard_components

    r = random.Random(1)
    huge = " ".join(f"w{r.randrange(5000)}" for _ in range(220_000))
    assert len(huge) > 2 * common.BLOCK_BYTES
    rows = [(1, huge, "s"), (2, huge + " end", "s"), (3, "a short text of nine words that stands alone", "s"), (4, huge, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2)
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    byte, word = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    assert {x.doc_id: x.n_tokens for x in token_counts(docs, BYTE).collect()} == {i: len(byte.encode(t, add_special_tokens=False).ids) for i, t, _ in rows}
    assert {x.doc_id: x.n for x in pack(docs, WORD).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == {i: len(word.encode(t, add_special_tokens=False).ids) + 1 for i, t, _ in rows}
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_components(docs).collect()} == {i: (len({tuple(w[j:j + 3]) for j in range(len(w) - 2)}), 3 if i == 3 else 1) for i, t, _ in rows for w in [t.split()]}
    assert {x.doc_id: x.keep_id for x in exact_groups(docs).collect()} == {1: 4, 2: 2, 3: 3, 4: 4}
    assert {x.doc_id: x.n_words for x in ledger(docs).collect()} == {i: len(t.split()) for i, t, _ in rows}
    assert drop_boilerplate(docs, "source").count() == 4 and mix(docs, labels).where("n_tokens > 200000").count() == 3
    for f in (quality_scores, toxicity_scores):
        assert all(0 <= x.score <= 1 for x in f(docs, labels).collect())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    assert compare(spark, QUERIES[name], ORACLE_SQL[name]) is None


def test_pipeline_keeps_and_packs(spark, tmp_path):
    """Every stage against plain Python on the supplied small table; clean documents stay."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact", "near", "mixing", "packing"]
    good = stages["quality"](spark, docs, d).cache()
    bad = {r.doc_id for r in quality_scores(docs, spark.read.parquet(f"{d}/labels.parquet")).collect() if r.predicted == 0}
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in docs.collect()} - bad
    exact = stages["exact"](spark, good, d).cache()
    best = {}
    for r in good.collect():
        best[lowered(r.text)] = max(best.get(lowered(r.text), -1), r.doc_id)
    assert sorted(r.doc_id for r in exact.collect()) == sorted(best.values())
    near = stages["near"](spark, exact, d).cache()
    sets = {r.doc_id: {tuple(w[i:i + 5]) for w in [words_of(r.text)] for i in range(max(1, len(w) - 4))} for r in exact.collect()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert sorted(r.doc_id for r in near.collect()) == sorted({find(x) for x in sets})
    assert near.columns == docs.columns
    mixed = stages["mixing"](spark, near, d).cache()
    assert mixed.columns == docs.columns
    pieces = stages["packing"](spark, mixed, d)
    assert pieces.where("piece = 0").count() == mixed.count()
