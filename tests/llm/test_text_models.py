"""Near duplicates, pieces, language model, personal data, pages and classifier against plain Python."""

import hashlib
import html
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
import sentencepiece

from nearcite.llm import components, html_extraction, kneser_ney, near_dedup, pii, piece_coding, quality_classifier

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n", "one", "a b c", "x" * 50_000, "the cat sat on " * 3000, "tab\tand\x0bfeed\x0c here\r\n", "é ü ß nbsp 日本 ▁ \x00 z", "  two  blanks "]


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, None, None) for i, t in zip(ids, texts, strict=True)], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


# near duplicates


def linked(rows, n=4):
    sets = {}
    for doc, text in rows:
        words = words_of(text)
        sets[doc] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                one, two = find(a), find(b)
                root[max(one, two)] = min(one, two)
    return {d: (len(sets[d]), find(d)) for d in sets}


def edited(words, rng, share):
    return [f"new{rng.random()}" if rng.random() < share else w for w in words]


def test_near_duplicates(spark, docs):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10_000)}" for _ in range(120)]
    family = [" ".join(edited(base, rng, 0.02)) for _ in range(300)]
    texts = [*ODD, *family, " ".join(base), " ".join(base).upper(), "a b c", "A  B\tc", "a b c d", "d c b a"]
    for rows in (docs, table(spark, texts)):
        given = [(r["doc_id"], r["text"]) for r in rows.collect()]
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.report(rows).collect()}
        want = linked(given)
        assert {d: v[:2] for d, v in got.items()} == want
        assert all(v[2] == (d == v[1]) for d, v in got.items())


def test_near_duplicates_of_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = table(spark, [text, text, text, None, ""], [7, 7, None, None, 3])
    got = sorted(map(str, [tuple(r) for r in near_dedup.report(rows).collect()]))
    assert got == sorted(map(str, [(7, 47, 7, True), (7, 47, 7, True), (None, 47, 7, False), (None, 0, None, True), (3, 0, 3, True)]))
    kept = near_dedup.unique_documents(rows.selectExpr("*", "1 AS _key", "2 AS _c"))
    assert kept.count() == 4 and set(kept.columns) == {*rows.columns, "_key", "_c"}
    assert near_dedup.report(rows.limit(0)).count() == 0


def test_pairs_of_a_crowded_region_are_all_found(spark):
    """1,500 texts share 85% of their shingles, too few to link; 40 pairs share more of the rest and must."""
    core = [f"c{i}" for i in range(173)]
    rows, want = [], {}
    for i in range(1500):
        own = [f"p{i // 2}_{k}" if i < 80 and k < 6 else f"o{i}_{k}" for k in range(27)]
        rows.append((f"d{i:04}", " ".join(core + own)))
        want[f"d{i:04}"] = f"d{i - i % 2 if i < 80 else i:04}"
    sets = [{" ".join(w[k : k + 4]) for k in range(len(w) - 3)} for w in (t.split() for _, t in rows[:4])]
    alike = lambda a, b: len(a & b) / len(a | b)
    assert alike(sets[0], sets[1]) >= 0.8 > alike(sets[1], sets[2])
    found = near_dedup.report(spark.createDataFrame(rows, "doc_id string, text string").repartition(4)).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == want


def test_blocks_of_large_regions_hold_all_rows():
    rng = np.random.default_rng(3)
    for keys in (rng.integers(0, 3, (5000, 8)), np.zeros((700, 8)), rng.integers(0, 2**32, (300, 8))):
        keys = keys[np.lexsort(keys.T[::-1])].astype(np.uint32)
        cuts = list(near_dedup._cut(keys, 0, len(keys), 0))
        assert all(1 <= b - a <= near_dedup.BLOCK for a, b in cuts)
        assert {i for a, b in cuts for i in range(a, b)} == set(range(len(keys)))


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(9, 9)]
    root = {x: x for pair in links for x in pair}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    got = components.components(spark.createDataFrame(links, "_a long, _b long")).collect()
    alone = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    assert {r["_node"]: r["_root"] for r in got} == {x: r for x, r in root.items() if x not in alone}
    assert len(got) == len({r["_node"] for r in got})


# pieces


def test_pieces_without_dropout_are_those_of_the_library(docs):
    reader = sentencepiece.SentencePieceProcessor(model_file=piece_coding.MODEL)
    texts = [r["text"] for r in docs.collect()] + ODD
    flat, bounds = piece_coding.encode_texts(pa.array(texts), np.arange(len(texts), dtype=np.uint64), piece_coding.MODEL, 1, 0.0)
    for i, text in enumerate(texts):
        ids = flat[bounds[i] : bounds[i + 1]].tolist()
        assert piece_coding.decode_ids(ids, piece_coding.MODEL) == (text or "")
        if text and "▁" not in text and "\0" not in text:
            assert ids == reader.encode(text)


def test_dropout_is_seeded_varied_and_lossless(spark, docs):
    rows = docs.union(table(spark, ODD, range(-len(ODD), 0)))
    one = {r["doc_id"]: r for r in piece_coding.report(rows).collect()}
    again = {r["doc_id"]: r["ids"] for r in piece_coding.report(rows.repartition(5)).collect()}
    assert {d: r["ids"] for d, r in one.items()} == again
    assert all(r["lossless"] and r["n_ids"] == len(r["ids"]) for r in one.values())
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    decoded = piece_coding.decode(piece_coding.report(rows)).collect()
    assert all(r["decoded"] == (texts[r["doc_id"]] or "") for r in decoded)
    other = {r["doc_id"]: r["ids"] for r in piece_coding.encode(rows, seed=2).withColumnRenamed("_id", "doc_id").collect()}
    assert sum(other[d] != r["ids"] for d, r in one.items()) > len(docs.collect()) / 2
    ids, bounds = piece_coding.encode_texts(pa.array(["thonanble " * 200]), np.array([5], np.uint64), piece_coding.MODEL, 1, 0.3)
    assert len({tuple(ids[i : i + 3].tolist()) for i in range(0, 300, 3)}) > 5


def test_long_units_agree_with_short_ones():
    v = piece_coding.vocabulary(piece_coding.MODEL)
    for word in (" thonanble", " Anerioustion", "   xx", " éèü日本", " aaaaaaaaaaaaaaaaaaaaaa"):
        chars = v.char_id[np.array([ord(c) for c in word])]
        for variant in range(20):
            for dropout in (0.0, 0.1, 0.5, 1.0):
                s, b = piece_coding._short_units(v, chars[None, :], np.array([variant]), 3, dropout)
                want = s[s != -2].tolist(), b[s != -2].tolist()
                assert piece_coding._long_unit(v, chars, variant, 3, dropout) == want


def test_every_occurrence_draws_for_itself():
    """Cut one by one, by the agenda, each with its own key: no occurrence may differ from what it gets among many."""
    v, seed, dropout, n = piece_coding.vocabulary(piece_coding.MODEL), 1, 0.1, 4000
    unit = " international"
    ids, _ = piece_coding.encode_texts(pa.array([unit.strip() + unit * (n - 1)]), np.array([7], np.uint64), piece_coding.MODEL, seed, dropout)
    chars = v.char_id[np.array([ord(c) for c in unit])]
    keys = piece_coding.mixed(np.uint64(7) + np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    each = [tuple(piece_coding._long_unit(v, chars, int(k), seed, dropout)[0]) for k in keys]
    assert [x for cut in each for x in cut] == ids.tolist()
    assert len(set(each)) > 60


def test_workers_need_no_copy_of_the_package(tmp_path):
    """The functions that tasks run travel with them: a process without this package can run them."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["a word or two"]), pa.array([5])], ["_id", "_text", "_k"])
    (tmp_path / "job").write_bytes(cloudpickle.dumps((piece_coding._coder(piece_coding.MODEL, 1, 0.1), batch)))
    code = "import pickle, sys; f, b = pickle.load(open(sys.argv[1], 'rb')); print(next(iter(f([b])))['lossless'][0])"
    done = subprocess.run([sys.executable, "-c", code, str(tmp_path / "job")], capture_output=True, text=True, cwd=tmp_path, env={"PATH": "/usr/bin"})
    assert done.stdout.strip() == "True", done.stderr


# language model


def test_base_scores_and_tokens(spark, docs):
    rows = docs.union(table(spark, ODD, range(-len(ODD), 0)))
    out = kneser_ney.report(rows).collect()
    texts = {r["doc_id"]: words_of(r["text"]) + [None] for r in rows.collect()}
    import zlib

    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    counts = Counter(w for d, ws in texts.items() if not held[d] for w in ws)
    total = sum(counts.values())
    for r in out:
        ws = texts[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ws), sum(counts[w] > 0 for w in ws), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in ws))
    better = [r["score"] > r["base_score"] for r in out if r["held_out"] and r["n_tokens"] > 50]
    assert np.mean(better) > 0.9


def brute_bigrams(texts):
    sents = [words_of(t) + [None] for t in texts]
    pairs = Counter((a, b) for s in sents for a, b in zip(["<s>", *s], s, strict=False))
    left = Counter(b for _, b in pairs)
    count = lambda c: [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
    d, low = kneser_ney.discounts_of(count(pairs)), kneser_ney.discounts_of(count(left))
    vocabulary = {w for s in sents for w in s}
    by_context = {}
    for (a, _), c in pairs.items():
        by_context.setdefault(a, []).append(c)
    cut = lambda c, of: of[min(c, 3) - 1] if c else 0
    floor = sum(cut(c, low) for c in left.values()) / sum(left.values())

    def word(w):
        return max(left[w] - cut(left[w], low), 0) / sum(left.values()) + floor / (len(vocabulary) + 1)

    def pair(a, w):
        seen = by_context.get(a)
        if not seen:
            return word(w)
        rest = sum(cut(c, d) for c in seen) / sum(seen)
        return max(pairs[a, w] - cut(pairs[a, w], d), 0) / sum(seen) + rest * word(w)

    return lambda t: sum(math.log10(pair(a, w)) for a, w in zip(["<s>", *words_of(t), None], [*words_of(t), None], strict=False))


def test_scores_are_those_of_modified_kneser_ney(spark, docs):
    train = docs.where("doc_id < 150")
    model = kneser_ney.fit(train)
    want = brute_bigrams([r["text"] for r in train.collect()])
    rows = docs.where("doc_id >= 140").union(table(spark, ["", None, "unseen words only", "the the the"], [-1, -2, -3, -4]))
    got = {r["_id"]: r["score"] for r in kneser_ney.score(rows, model).collect()}
    for r in rows.collect():
        assert got[r["doc_id"]] == pytest.approx(want(r["text"]), rel=1e-9)
    scorer = kneser_ney.Scorer(model)
    for context in (0, 3, model.words // 2, model.words, model.start):
        keys = np.uint64(context) << np.uint64(32) | np.arange(model.words + 1, dtype=np.uint64)
        assert scorer.probability(keys).sum() == pytest.approx(1)


def test_model_of_nothing(spark, docs):
    for rows in (docs.limit(0), table(spark, [None, ""])):
        model = kneser_ney.fit(rows)
        out = kneser_ney.score(docs.limit(3), model).collect()
        assert len(out) == 3 and all(math.isfinite(r["score"]) for r in out)
    assert kneser_ney.report(docs.limit(0)).count() == 0


def test_packed_runs_come_back():
    rng = np.random.default_rng(2)
    for n in (0, 1, 1000):
        keys, counts = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)), None
        counts = rng.integers(1, 1 << 40, len(keys))
        back = kneser_ney._unpacked(kneser_ney._packed(keys, counts), len(keys))
        assert (back[0] == keys).all() and (back[1] == counts).all()


# personal data

BASE = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def luhn(digits):
    values = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in values) % 10 == 0


def personal(text):
    found = []
    for kind, regex in BASE:
        for m in regex.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {
                "email": lambda v, d: True, "ip": lambda v, d: all(int(p) <= 255 for p in v.split(".")),
                "card": lambda v, d: 13 <= len(d) <= 19 and luhn(d), "phone": lambda v, d: 9 <= len(d) <= 15,
            }[kind](m[0], digits)
            if fine:
                found.append((kind, m.start(), m.end()))
    return found


HARD = [
    "a@b.c.d@e.f g", "a@b.c-_x@d.e", "..@x.y", "a@b a@b.c@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1 1.256.1.1 0001.2.3.004 1.2.3", "4111 1111 1111 1111",
    "4111-1111-1111-1112 4111111111111111x", "1" * 9000, "1 " * 9000, "9" * 13 + "." + "8", "+1 (640) 555-0953 +49--30 123456789012 +1", "+1 2 3 4 5 6 7 8 9",
    "é日本 me@x.org\n1.2.3.4", "a" * 40_000, "token = \"deadbeef0123\"", "ip 1.2.3.4.card 4111111111111111",
]


@pytest.mark.parametrize("source", ["given", "odd"])
def test_base_spans(spark, docs, source):
    rows = docs if source == "given" else table(spark, ODD + HARD)
    got = {r["doc_id"]: r for r in pii.report(rows).collect()}
    for doc in rows.collect():
        r, want = got[doc["doc_id"]], personal(doc["text"])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert tuple(r[f"n_{k}"] for k, _ in BASE) == tuple(sum(w[0] == k for w in want) for k, _ in BASE), doc["text"][:60]
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert r["spans"] == joined or r["spans"].startswith(joined + ("," if joined else ""))


def test_a_text_of_very_many_addresses(spark):
    """Positions, overlaps and contexts of one long text in time and memory about as long as the text."""
    text = " ".join(f"u{i}@m{i % 97}.org" + (" id QX-99812-7761 4111 1111 1111 1111\n" if i % 999 == 0 else "") for i in range(60_000))
    rows = table(spark, [text, text, "é" * 3000 + " x@y.org"], ids=[1, 1, 2]).withColumns({"_key": F.lit(1), "s": F.lit("x")})
    got = pii.report(rows).collect()
    assert len(got) == 3 and got[0]["n_email"] + got[1]["n_email"] + got[2]["n_email"] == 120_001
    for r in got:
        want = personal(text if r["doc_id"] == 1 else "é" * 3000 + " x@y.org")
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
    assert pii.report(rows.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 7, 8, 9, 100, 1001])
def test_running_results(spark, n):
    rows = spark.range(1).select(F.sequence(F.lit(1), F.lit(n)).alias("v") if n else F.array().cast("array<int>").alias("v"))
    sums = rows.select(pii.scanned(F.col("v"), F.lit(0), lambda a, x: a + x)).first()[0]
    assert sums == [i * (i + 1) // 2 for i in range(1, n + 1)]


def test_places_that_overlap_a_span_are_no_candidates(spark):
    rng = random.Random(2)
    cut = lambda k: sorted({(a, a + rng.randint(1, 6)) for a in rng.sample(range(120), k)})
    for _ in range(5):
        base = {k: cut(6) for k in pii.FORMATS}
        found = [(a, b, "v") for a, b in cut(30)]
        kinds = ", ".join(f"{k}:{pii.FOUND}" for k in pii.FORMATS)
        rows = spark.createDataFrame([({k: [(a, b, "") for a, b in v] for k, v in base.items()}, found)], f"base struct<{kinds}>, found {pii.FOUND}")
        free = {tuple(x) for x in rows.select(pii._free(F.col("base"), F.col("found"))).first()[0]}
        assert free == {(a, b, v) for a, b, v in found if not any(s < b and e > a for spans in base.values() for s, e in spans)}


def test_contexts_find_what_no_format_does(spark):
    rng = random.Random(7)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n - 2)) + "a1"
    prose = ["the house on the hill was built in 1987 and sold", "number 12345678 of the list was lost"] * 10
    seeds = [f"some words token = \"{hexes(40)}\" more" for _ in range(30)] + [f"please write to user id mail{i}x1234@x.org today" for i in range(20)]
    hidden = ["odd words TOKEN = \"9233A8ECF7C5B09FE594\" here", "please write to user id QX-99812-7761 today"]
    rows = table(spark, prose + seeds + hidden)
    got = {r["doc_id"]: r["spans"] for r in pii.report(rows).collect()}
    assert all(got[i] == "" for i in range(20))
    assert all(got[20 + i].startswith("secret:") for i in range(30))
    assert got[70] == "secret:19:39" and got[71] == "other:24:37"


# pages


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


CASES = [
    ("<nav>menu</nav><article><h1>A&amp;B</h1><p>one <b>two</b>three<br>four<p>five &eacute;</article><footer>f</footer>", "A&B one twothree four five é"),
    ("<div class='sidebar'>s</div><main><div>x</div><aside>no</aside>y<ul><li>a<li>b</ul></main>", "x y a b"),
    ("<header>h</header><div id=cookie-notice>n</div><p>kept</p><form>q</form><script>var t='</p>'</script><style>p{}</style>", "kept"),
    ("<article>main<div class=\"comments\"><p>reader</p></div><div class='ad banner'>buy</div> end</article>", "main end"),
    ("<p>un < closed & <i>it", "un < closed & it"),
    ("<article></article><p>body</p>", "body"),
    ("<article><p hidden>no</p><!-- c --><table><tr><td>1<td>2<tr><td>3</table></article>", "1 2 3"),
    ("", ""),
]


def test_extraction_of_pages():
    for body, want in CASES:
        assert html_extraction.extract(page(body)) == want, body
    assert html_extraction.extract(None) == "" and html_extraction.extract("") == ""
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert html_extraction.extract(page(deep)) == "x"


def test_site_templates_go_and_copies_stay(spark):
    boiler = "<div><p>Read more about our terms and friends</p></div>"
    rows = [(i, f"https://a.example/{i}", page(f"{boiler}<div><p>story number {i}</p></div>")) for i in range(8)]
    rows += [(100 + i, f"http://B.example:80/{i}", page("<div><p>the same article</p></div>")) for i in range(8)]
    rows += [(200, None, None), (201, "no host", page("<p>alone</p>")), (None, "https://a.example/z", page(f"{boiler}<p>last</p>"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extraction.report(pages.selectExpr("*", "1 AS _host", "2 AS text")).collect()}
    assert all(got[i] == (f"story number {i}", len(f"story number {i}")) for i in range(8))
    assert all(got[100 + i][0] == "the same article" for i in range(8))
    assert got[200] == ("", 0) and got[201][0] == "alone" and got[None][0] == "last"
    assert html_extraction.report(pages.limit(0)).count() == 0


def test_elements_nest_to_any_depth():
    for n in (450, 5000, 100_000):
        deep = "<div>" * n + "<nav>MENU</nav>body" + "</div>" * n + "tail"
        assert html_extraction.extract(page(deep)) == "body tail"
        assert html_extraction.extract(page("<b>" * n + "x" + "</i>" * n + "<div>y</div>")) == "x y"
        root = html_extraction.parse(page(deep))
        assert len(html_extraction.subtree_hashes(root)) >= n


def test_a_section_has_a_template_of_its_own(spark):
    """A notice on every page of one section, a sixth of the site, that no name gives away; pages without a host have none."""
    note = "<div class=x1><p>call our desk</p></div>"
    rows = [(i, f"https://a.example/news/{i}", page(f"{note}<div><p>news number {i}</p></div>")) for i in range(8)]
    rows += [(100 + i, f"https://a.example/{'abcdef'[i % 6]}/{i}", page(f"<div><p>text number {i}</p></div>")) for i in range(40)]
    rows += [(200 + i, None, page(f"{note}<div><p>lost number {i}</p></div>")) for i in range(8)]
    got = {r["page_id"]: r["text"] for r in html_extraction.report(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"news number {i}" for i in range(8)) and all(got[100 + i] == f"text number {i}" for i in range(40))
    assert all(got[200 + i] == f"call our desk lost number {i}" for i in range(8))


def test_given_pages_give_their_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_extraction.report(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        assert got[r["page_id"]] == " ".join(html.unescape(re.sub(r"</?(p|br|h1)>", " ", inner).replace("<b>", "").replace("</b>", "")).split())


# classifier


def test_classifier_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    out = quality_classifier.report(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    good, bad = [r for r in out if r["quality"] == 1], [r for r in out if r["quality"] == 0]
    assert np.mean([r["kept"] for r in good]) > 0.97 and np.mean([r["kept"] for r in bad]) < 0.3
    order = np.mean([(a["score"] > b["score"]) + 0.5 * (a["score"] == b["score"]) for a in good for b in bad])
    assert order > 0.9


def test_sparse_sites_shrink(spark):
    rows = [("big", "x", float(i < 90)) for i in range(100)] + [("tiny", "x", 0.0)] + [(f"h{j}", "x", float(i < 5)) for j in range(20) for i in range(10)]
    mean, strength, hosts, paths = quality_classifier.site_priors(spark.createDataFrame(rows, "_host string, _path string, _y double"))
    prior = {r["_host"]: r["_host_prior"] for r in hosts.collect()}
    path = {r["_host"]: r["_path_prior"] for r in paths.collect()}
    assert abs(prior["tiny"] - mean) < abs(prior["tiny"] - 0) and prior["big"] > 0.8 and strength >= 1
    assert 0 < path["tiny"] < prior["tiny"]


def test_classifier_of_odd_tables(spark, docs):
    labels = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (2, None), (None, 1), (999, 1)], "doc_id long, quality int")
    rows = docs.limit(20).union(table(spark, ODD, [None, *range(-1, -len(ODD), -1)])).selectExpr("*", "1 AS _x", "2 AS score")
    out = quality_classifier.report(rows, labels)
    assert out.count() == 20 + len(ODD) and out.where("score IS NULL OR isnan(score)").count() == 0
    assert quality_classifier.report(rows, labels.limit(0)).where("kept AND score = 0.5").count() == 20 + len(ODD)
    assert quality_classifier.report(rows.limit(0), labels).count() == 0


def test_mails_and_accepted_values_seed_patterns(spark):
    """Mails of few digits lead to handles in their context, and those to more in a context no mail has."""
    mails = [f"please write to person{a}{b}@mail.example.com today or never" for a in "abcde" for b in "abcdefghij"]
    first = [f"please write to handle{1000 + i} today or never" for i in range(10)]
    again = [f"he is known as handle{1000 + i} over there" for i in range(11)]  # the last is in no other context
    found = {r["doc_id"]: r["spans"] for r in pii.report(table(spark, [*mails, *first, *again])).collect()}
    assert [d for d in sorted(found) if "other:" in found[d]] == list(range(50, 71))
