import hashlib
import zlib

import duckdb
import numpy as np
import pytest

from logloom.llm import html_extract, media, url_filter

from .conftest import DOCS, prose

# -- URL filters -------------------------------------------------------------------------------

URLS = [
    "http://A.Example.ORG/es/1", "https://example.org/en/12?x", "https://m.example.org/en/2", "http://x.org", "http://x.com/fr/", "http://x.com/de/a#b", "com", None, "", "ftp://", "http://xorg/",
    "http://www.spam-farm.example.net/en/1000/", "https://m.Spam-Farm.example.net/es/9999?q=1", "http://spam-farm.example.net/en/999", "http://spam-farm.example.net/en/1000.html", "http://b.net/a\nb?c", "x://y://z/p",
    "http://blog.spam-farm.example.org/es/1000", "HTTP://WWW.ads-track.example.com/fr/2000", "http://ads-track.example.com/en/2000#x", "http://ÀB.com/de/", "http://www.ads-track.example.com", "http://old.ads-track.example.com/en/2000",
]


def test_urls_against_sql(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(11, URLS[11]), (None, URLS[0])]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = url_filter.filter_urls(pages, url_filter.default_list(spark)).select("page_id", "host", "path", "rule", "verdict").collect()
    con = duckdb.connect()
    con.execute("create table pages(page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", rows)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, con.execute(url_filter.OP10_SQL).fetchall()))
    # listed URLs share their hosts with clean ones
    verdict = {r["host"] + r["path"]: r["verdict"] for r in got}
    assert verdict["www.spam-farm.example.net/en/1000/"] == "block" and verdict["spam-farm.example.net/en/999"] == verdict["spam-farm.example.net/en/1000.html"] == "allow"


def test_list_from_a_table(spark, tmp_path):
    pages = [(1, "https://www.good.net/a/"), (2, "http://good.net/b"), (3, "http://good.net/a?x"), (4, None)]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([("http://good.net/a", 1), (None, 2), ("http://good.net/a", 3)], "url string, page_id long").write.parquet(str(tmp_path / "list"))
    got = url_filter.op10(spark, str(tmp_path), list_path=str(tmp_path / "list")).collect()
    assert {r["page_id"]: r["verdict"] for r in got} == {1: "block", 2: "allow", 3: "block", 4: "allow"}


def test_bloom_never_misses_and_join_is_exact(spark):
    pages = spark.range(3000).selectExpr("id as page_id", "concat('http://h', id, '.net/p') as url", "'x' as host", "1 as _key", "2 as block", "3 as rule")
    listed = pages.where("page_id % 3 = 0").select("url")
    for blocks in (4, None, 1 << 16):
        out = url_filter.filter_urls(pages, listed, blocks=blocks)
        assert out.count() == 3000 and out.where("(verdict = 'block') <> (page_id % 3 = 0)").count() == 0
    assert url_filter.filter_urls(pages.limit(0), listed).count() == 0
    assert url_filter.filter_urls(pages, listed.limit(0)).where("verdict = 'block'").count() == 0


# -- HTML --------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>x</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site"><h1>Site</h1><form><input><label>Search here.</label></form></header><nav><ul><li><a href="/a">A</a></ul></nav>
<div id="cookie-notice"><p>We use cookies to make this better. Accept them.</p></div><div class="layout"><div class="sidebar"><p>About us: a paper with a long history of writing.</p></div>
%s<h1>Title &amp; more</h1><p>First <b>long</b> para&shy;graph of the story,
 which says a good deal.<br>And on.<p>Second&nbsp;paragraph is also long, with <a href=y>a link</a>.</p><div class="ad">Buy now, it is cheap.</div><!-- no --><script>x()</script><aside>Aside it goes.</aside>%s
<section class="comments"><p>I think that this is a very good article, my friend.</p></section></div><footer>&copy; us, all rights reserved.</footer></body></html>"""
TEXT = "Title & more First long para\u00adgraph of the story, which says a good deal. And on. Second paragraph is also long, with a link."


@pytest.mark.parametrize("open_, close", [("<article>", "</article>"), ('<main id="c">', "</main>"), ('<div class="post-content">', "</div>")])
def test_page(open_, close):
    assert html_extract.main_text(html_extract.Model(), PAGE % (open_, close)) == TEXT


def test_trained_on_labelled_pages(spark, rng):
    rows = [(i, f"http://h/{i}", PAGE.replace("First", prose(rng, 20)) % ("<article>", "</article>")) for i in range(30)] + [(90, None, None), (91, "u", ""), (92, "u", "<"), (None, "u", "<p a='"), (93, "u", "<article><p>Cut in the middle of a sentence that goes on, and <b")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as n_chars", "'t' as text")
    model = html_extract.train(pages)
    got = {r["page_id"]: r for r in html_extract.extract(pages, model).collect()}
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got.values())
    for i, _, h in rows[:30]:
        assert got[i]["text"] == TEXT.replace("First", h.split("more</h1><p>")[1].split(" <b>")[0])
    assert [got[i]["text"] for i in (90, 91, 92)] == ["", "", ""] and got[93]["text"] == "Cut in the middle of a sentence that goes on, and"
    assert html_extract.extract(pages.limit(0), model).count() == 0


def brute(model, blocks):
    """Marginals by summing over all labellings."""
    import itertools
    import math

    total, on = 0.0, [0.0] * len(blocks)
    own = [model.potential(b) for b in blocks]
    for y in itertools.product((0, 1), repeat=len(blocks)):
        w = 1.0
        for i, b in enumerate(blocks):
            w *= math.exp(own[i] * y[i])
            if i:
                w *= math.exp(model.edges[html_extract.edge(blocks, b)][2 * y[b.parent] + y[i]])
        total += w
        for i, k in enumerate(y):
            on[i] += w * k
    return [x / total for x in on]


SMALL = "<div><p>Some words here.</p><ul><li><a>l</a></li><li>Two</li></ul><div class=post><h2>T</h2><p>More words, and more. On.</p></div><div class=ad><p>Buy.</div></div>"


@pytest.mark.parametrize("weights", [{}, {"tag=li": 3.0, "in:01": 2.0, "plain:11": -1.0, "length=1": 0.7}])
def test_messages_give_the_marginals(weights):
    model = html_extract.Model(weights)
    blocks, runs = html_extract.parse(SMALL)
    want = brute(model, blocks)
    assert model.marginals(blocks) == pytest.approx(want)
    assert html_extract.main_text(model, SMALL) == " ".join(s for b, s in runs if want[b] > 0.5)


def test_gradient_is_that_of_the_likelihood():
    """What the gradient says against the likelihood itself, by enumeration, a little to either side."""
    import itertools
    import math

    blocks, _ = html_extract.parse(SMALL.replace("<div>", "<article>", 1))
    y = html_extract.labels(blocks)
    (page,) = [r[1:] for r in next(html_extract._labelled([__import__("pandas").DataFrame({"html": [SMALL.replace("<div>", "<article>", 1)]})])).itertuples()][:1]

    def loglik(weights):
        m = html_extract.Model(weights)

        def score(y):
            return sum(m.potential(b) * k for b, k in zip(blocks, y, strict=True)) + sum(m.edges[html_extract.edge(blocks, b)][2 * y[b.parent] + y[i]] for i, b in enumerate(blocks) if i)

        return score(y) - math.log(sum(math.exp(score(z)) for z in itertools.product((0, 1), repeat=len(blocks))))

    weights = html_extract.prior() | {"tag=li": 0.3}
    got = html_extract.gradient(weights, [page])
    for f in ("tag=p", "tag=li", "links=0", "in", "plain:11", "plain:01", "in:00", "top:01"):
        up, down = (loglik(weights | {f: weights[f] + d}) for d in (1e-4, -1e-4))
        assert got.get(f, 0.0) == pytest.approx((up - down) / 2e-4, abs=1e-5), f


def _junk_page(r):
    """A page whose teasers and boxes are known by words of their classes that no list has, and look like prose; its text."""
    body = [f"<p>{prose(r, r.randint(1, 40))}.</p>" for _ in range(r.randint(1, 6))]
    box = lambda c: f'<div class="{c}"><p>{prose(r, 30)}. {prose(r, 20)}.</p><p>{prose(r, 12)}.</p></div>'
    return f"<html><body><nav><a href=x>Home</a></nav>{box('zqteaser')}<article>{''.join(body)}</article>{box('xvbox')}<footer>All rights.</footer></body></html>", " ".join(b[3:-4] for b in body)


def _f1(a, b):
    from collections import Counter

    a, b = Counter(a.split()), Counter(b.split())
    return 2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values()))


def test_trained_model_decides(spark, rng):
    """Held-out pages whose <article> is stripped, or another tag: what was learnt from labelled pages finds their text, the untrained model does not."""
    pages = spark.createDataFrame([(i, _junk_page(rng)[0]) for i in range(120)], "page_id long, html string")
    model, held = html_extract.train(pages), [_junk_page(rng) for _ in range(60)]
    for change in (("<article>", ""), ("article", "section")):
        score = lambda m, c=change: sum(_f1(html_extract.main_text(m, h.replace(*c)), t) for h, t in held) / len(held)
        assert score(model) > 0.97 > 0.8 > score(html_extract.Model())


def test_nothing_of_the_article_is_dropped(spark):
    """By-lines, lists of tags, tables, lists, links and hidden blocks of an article stay; menus, forms, adverts and comments in it go."""
    page = (
        "<body><article><h1>Title</h1><div class=byline>By Joe</div><ul><li>one<li>two</ul><table><tr><td>cell<td>other</table><p hidden>Not shown.</p><div aria-hidden=true>Nor this.</div>"
        "<p><a href=x>All link</a></p><ul class=tags><li><a href=t>t1</a></ul><p>Some text of the article. It is long, and says much.</p><nav>menu</nav><form>Name?</form>"
        "<div class=comments><p>Long comment text. It is nice.</p><p>One more comment. Bye.</p></div><div class=ad>Buy</div></article></body>"
    )
    want = "Title By Joe one two cell other Not shown. Nor this. All link t1 Some text of the article. It is long, and says much."
    pages = spark.createDataFrame([(i, PAGE % ("<article>", "</article>")) for i in range(40)], "page_id long, html string")
    assert html_extract.main_text(html_extract.train(pages), page) == want


def test_deep_pages_cost_their_length():
    import time

    began = time.perf_counter()
    html_extract.main_text(html_extract.Model(), "<div><li>" * 55_000 + "<p><a>" * 55_000 + "x")
    html_extract.parse("<div>" * 100_000 + "</b></p></div>" * 40_000)
    assert time.perf_counter() - began < 8
    began = time.perf_counter()
    html_extract.main_text(html_extract.Model(), "<div>" * 95_000 + "x" + "</div>" * 95_000)  # a page of 1 MB
    assert time.perf_counter() - began < 5  # alone about 1.8 s


# -- media -------------------------------------------------------------------------------------


def slow_read(f):
    """A progressive reader, a bit at a time: coefficients of each component's blocks."""
    at, tables, every, coef = 2, {}, 0, {}
    while True:
        mark, size = f[at + 1], int.from_bytes(f[at + 2 : at + 4], "big")
        if mark == 0xD9:
            return coef
        body = f[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xDD:
            every = int.from_bytes(body, "big")
        if mark == 0xC2:
            h, w = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            for i in range(body[5]):
                c, s = body[6 + 3 * i], body[7 + 3 * i]
                unit = 16 if body[5] > 1 else 8
                coef[c] = [[0] * 64 for _ in range((h // unit) * (w // unit) * (s >> 4) * (s & 15))]
        if mark == 0xC4:
            while body:
                code, k, t = 0, 17, {}
                for n in range(1, 17):
                    for _ in range(body[n]):
                        t[n, code] = body[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                tables[body[0]], body = t, body[k:]
        if mark == 0xDA:
            comp, (first, last, ahl) = body[1], body[3:6]
            before, left = ahl >> 4, ahl & 15
            end = at
            while not (f[end] == 255 and f[end + 1] != 0 and not 0xD0 <= f[end + 1] <= 0xD7):
                end += 1
            parts, k, cur = [], at, bytearray()
            while k < end:
                if f[k] == 255 and f[k + 1]:
                    parts.append(cur)
                    cur, k = bytearray(), k + 2
                else:
                    cur.append(f[k])
                    k += 1 + (f[k] == 255)
            parts.append(cur)
            t = tables.get((0x10 if first else 0) | 0, {})
            for p, lane in enumerate(parts):
                bits = iter("".join(f"{x:08b}" for x in lane))
                take = lambda n, b=bits: int("0" + "".join(next(b) for _ in range(n)), 2)

                def symbol(b=bits, t=t):
                    code = 0
                    for n in range(1, 17):
                        code = code << 1 | int(next(b))
                        if (n, code) in t:
                            return t[n, code]

                def value(s):
                    v = take(s)
                    return v if s == 0 or v >> (s - 1) else v - (1 << s) + 1

                pred = skip = 0
                for c in coef[comp][p * every : (p + 1) * every]:
                    if first == 0:
                        if before:
                            c[0] |= take(1) << left
                        else:
                            pred += value(symbol())
                            c[0] = pred << left
                        continue
                    k = first
                    if not before:
                        if skip:
                            skip -= 1
                            continue
                        while k <= last:
                            r, s = divmod(symbol(), 16)
                            if s:
                                k += r
                                v = value(s)
                                c[k] = v * (1 << left)
                            elif r == 15:
                                k += 15
                            else:
                                skip = (1 << r) - 1 + take(r)
                                break
                            k += 1
                        continue

                    def correct(k):
                        if take(1):
                            c[k] += (1 if c[k] > 0 else -1) << left

                    while k <= last and not skip:
                        r, s = divmod(symbol(), 16)
                        new = (1 if take(1) else -1) if s else 0
                        if not s and r < 15:
                            skip = (1 << r) + take(r)
                            break
                        while k <= last:
                            if c[k]:
                                correct(k)
                            elif r == 0:
                                c[k] = new * (1 << left)
                                k += 1
                                break
                            else:
                                r -= 1
                            k += 1
                    if skip:
                        for k in range(k, last + 1):
                            if c[k]:
                                correct(k)
                        skip -= 1
            at = end


def slow_write(coef, every):
    """A one-component progressive file of any coefficients, a bit at a time, with runs of ended bands."""
    dc, ac = media._codes(media._DC_SYMBOLS), media._codes(media._AC_SYMBOLS)
    sym = lambda t, s: f"{t[0][s]:0{t[1][s]}b}"
    num = lambda v, s: f"{v if v >= 0 else v + (1 << s) - 1:0{s}b}" if s else ""
    shift = lambda v, n: v >> n if v >= 0 else -(-v >> n)
    out = bytearray(b"\xff\xd8" + media._segment(0xFE, b"0") + media._TABLES[:69])
    out += media._segment(0xC2, bytes([8, 0, 8, *(8 * len(coef)).to_bytes(2, "big"), 1, 1, 0x11, 0])) + media._TABLES[69:-6]
    out += media._segment(0xDD, every.to_bytes(2, "big"))
    for first, last, before, left in ((0, 0, 0, 1), (1, 20, 0, 1), (21, 63, 0, 1), (0, 0, 1, 0), *((k, min(k + 14, 63), 1, 0) for k in range(1, 64, 15))):
        out += media._segment(0xDA, bytes([1, 1, 0, first, last, before << 4 | left]))
        for n, lane in enumerate(range(0, len(coef), every)):
            s, pred, run, held = "", 0, 0, ""

            def flush():
                nonlocal s, run, held
                if run:
                    r = run.bit_length() - 1
                    s += sym(ac, r << 4) + (f"{run - (1 << r):0{r}b}" if r else "") + held
                run, held = 0, ""

            for c in coef[lane : lane + every]:
                if first == 0:
                    v = c[0] >> left
                    if before:
                        s += str(v & 1)
                    else:
                        k = abs(v - pred).bit_length()
                        s, pred = s + sym(dc, k) + num(v - pred, k), v
                    continue
                r, bits = 0, ""
                for k in range(first, last + 1):
                    v = shift(c[k], left)
                    old = shift(c[k], 1) if before else 0
                    if before and old:
                        bits += str(abs(v) & 1)
                    elif v == 0:
                        r += 1
                    else:
                        if run:
                            flush()
                        while r > 15:  # only in first scans: a later band is 15 coefficients at most
                            s += sym(ac, 0xF0)
                            r -= 16
                        m = abs(v).bit_length()
                        s += sym(ac, r << 4 | (1 if before else m)) + ((("1" if v > 0 else "0") + bits) if before else num(v, m))
                        r, bits = 0, ""
                if r or bits:
                    run += 1
                    held += bits
                    if run == 1:  # symbols for longer runs are not in these tables
                        flush()
            flush()
            s += "1" * (-len(s) % 8)
            for k in range(0, len(s), 8):
                b = int(s[k : k + 8], 2)
                out += bytes([b, 0] if b == 255 else [b])
            if lane + every < len(coef):
                out += bytes([255, 0xD0 + n % 8])
    return bytes(out + b"\xff\xd9")


def test_reader_against_slow_reader(rng):
    payloads = [media.padded(t) for t in (b"", b"x", bytes(range(256)) * 3, prose(rng, 400).encode(), b"\xff" * 64, b"\0" * 640)]
    files = media.write(payloads)
    coef, shapes = media.read(files)
    for f, s, p in zip(files, shapes, payloads, strict=True):
        slow = slow_read(f)
        for c, (o, n) in s["at"].items():
            assert coef[o : o + n].tolist() == slow[c]
        assert media.payload(coef, s) == p


@pytest.mark.parametrize("every", [1, 3, 1000])
def test_reader_takes_zeros_and_runs(rng, every):
    blocks = []
    for _ in range(17):
        c = [rng.randint(-300, 300)] + [0] * 63
        for k in rng.sample(range(1, 64), rng.choice([0, 1, 3, 20, 63])):
            c[k] = rng.choice([-1, 1, 1, 2, -3, 40, -500])
        blocks.append(c)
    f = slow_write(blocks, every)
    assert slow_read(f)[1] == blocks
    coef, _ = media.read([f])
    assert coef.tolist() == blocks


def test_tensor_is_the_inverse_transform(rng):
    coef, shapes = media.read(media.write([media.padded(b"abc")]))
    rgb = media.tensors(coef, shapes)[0]
    u = np.arange(8)
    cos = np.cos((2 * u[:, None] + 1) * u[None, :] * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    planes = []
    for c, (o, _) in shapes[0]["at"].items():
        block = np.zeros(64)
        block[media.ZIGZAG] = coef[o]
        planes.append(np.clip(np.rint(cos @ block.reshape(8, 8) @ cos.T + 128), 0, 255))
    y, cb, cr = planes
    want = np.clip(np.rint([y[0, 0] + 1.402 * (cr[0, 0] - 128), y[0, 0] - 0.344136 * (cb[0, 0] - 128) - 0.714136 * (cr[0, 0] - 128), y[0, 0] + 1.772 * (cb[0, 0] - 128)]), 0, 255)
    assert rgb.shape == (16, 16, 3) and np.abs(rgb[0, 0].astype(int) - want).max() <= 1


def test_media_columns(spark, odd_docs, no_docs, odd_rows):
    stored = media.store(odd_docs)
    got = media.digests(stored)
    assert sorted(got.columns) == sorted({*odd_docs.columns, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"} - {"media"})
    got, by = got.collect(), {}
    assert len(got) == len(odd_rows)
    for r in got:
        raw = (r["text"] or "").encode()
        p = media.padded(raw)
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert by.setdefault(raw, (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])
    back = media.load(stored).select("text", "payload", "height", "width", "rgb").collect()
    assert all(r["payload"] == media.padded((r["text"] or "").encode()) and len(r["rgb"]) == 3 * r["height"] * r["width"] for r in back)
    assert media.load(spark.createDataFrame([(None,)], "media binary")).first()["payload"] is None
    assert media.digests(media.store(no_docs)).count() == 0


def test_media_query(spark, odd_docs, odd_rows, tmp_path):
    odd_docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r["n_bytes"], r["payload_bytes"]) for r in media.op7(spark, str(tmp_path)).collect())
    sizes = [len((t or "").encode()) for _, t, *_ in odd_rows]
    assert got == sorted((n, max(64, -(-n // 64) * 64)) for n in sizes)


def test_extract_keeps_odd_columns(spark, odd_docs, odd_rows):
    pages = odd_docs.withColumnRenamed("text", "html")
    out = html_extract.extract(pages, html_extract.Model())
    assert sorted(out.columns) == sorted({*odd_docs.columns, "n_chars"}) and out.count() == len(odd_rows)


# -- pipeline ----------------------------------------------------------------------------------


def test_pipeline(spark, rng, tmp_path):
    import corpus_pipeline

    item = prose(rng, 40)
    rows = [(i, prose(rng, rng.randint(30, 90)), "en", "s", 1) for i in range(80)]
    rows += [(100 + i, rows[i][1], "en", "s", 1) for i in range(5)] + [(110, prose(rng, 20) + " " + item + " " + prose(rng, 20), "en", "s", 1)]
    rows += [(120 + i, " ".join(x for w in prose(rng, 40).split() for x in (w, rng.choice(["idiot", "moron", "scum"]))), "en", "s", 1) for i in range(12)]
    rows += [(140, prose(rng, 50) + " Mail me: joe@example.org now.", "en", "s", 1), (141, None, None, None, None), (None, "no id at all", None, None, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, int(120 <= i < 140)) for i, *_ in rows if i is not None and i % 4], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got.keys() == {None, *range(80), 140, 141} and got[141]["n_ids"] == 0
    from logloom.llm import pieces

    v = pieces.Vocabulary(pieces.MODEL_FILE)
    assert pieces.decode(v, got[140]["ids"]).endswith("Mail me: [EMAIL] now.")
    assert pieces.decode(v, got[7]["ids"]) == rows[7][1]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "encode"]
