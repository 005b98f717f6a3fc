"""Trees, repetition, toxicity, quality, main text and URL rules."""

import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollcall.llm import byte_conv, url_rules
from rollcall.llm.byte_conv import quality
from rollcall.llm.main_text import FEATURES, KINDS, blocks_of, block_tree, extract, labelled_page, labelled_table, main_text
from rollcall.llm.main_text import features as block_features
from rollcall.llm.queries import held_out
from rollcall.llm.repetition import COUNTS, SHARES, measures, repetition
from rollcall.llm.toxicity import INSULTS, SECOND, features, sample_labelled, split_lexicon, toxicity
from rollcall.llm.toxicity import words_of as toxicity_words
from rollcall.llm.trees import boost, isotonic, sigmoid
from rollcall.llm.url_rules import ending_rule, folder_rule, host_rule, judge_urls, name_rule, registered_rules

BIG = "/root/testdata/sf0.1"


def test_trees_and_curve():
    r = np.random.default_rng(0)
    x = r.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    z = boost(x, y).predict(x)
    assert ((z > 0) == y).mean() > 0.97
    p = isotonic(z, y).predict(np.sort(z))
    assert (np.diff(p) >= 0).all() and p.min() > 0 and p.max() < 1


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    inside = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 3)}
    seen, lines, chars = set(), 0, 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            if line in seen:
                lines, chars = lines + 1, chars + sum(map(len, re.findall(r"[^\x20\x09-\x0D]+", line)))
            seen.add(line)
    out = [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), lines, len(inside), chars]
    for n in SHARES:
        seen, covered = set(), set()
        for i in range(len(words) - n + 1):
            w = tuple(words[i:i + n])
            covered |= set(range(i, i + n)) if w in seen else set()
            seen.add(w)
        out.append(sum(len(words[k]) for k in covered))
    return tuple(out)


def test_repetition(odd, none, docs):
    for df in (docs, odd.filter("doc_id <> 7")):
        rows = df.select("doc_id", "text").collect()
        got = repetition(df).collect()
        assert sorted(str((r.doc_id, *(r[c] for c in COUNTS))) for r in got) == sorted(str((r.doc_id, *plain(r.text))) for r in rows)
        for r in got:
            assert r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words) and not (r.base_failed and r.kept)
    assert repetition(none).count() == 0


def test_repetition_verdict():
    good = " ".join(f"w{i}" for i in range(200))
    half = " ".join(f"w{i}" for i in range(100))
    assert measures(good)[4] == 0 and measures(f"{half} {half}")[4] == 200
    many = measures(" ".join(f"w{i}" for i in range(40)) + " " + " ".join(f"w{i}" for i in range(10, 20)))
    assert many[6] == sum(len(f"w{i}") for i in range(10, 20))


def test_toxicity_held_out(spark, docs):
    df = spark.read.parquet(f"{BIG}/documents.parquet")
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    got = toxicity(df, labels).join(labels, "doc_id").filter(held_out(5, 0)).select("toxic", "predicted", "score").collect()
    bad = [r.predicted for r in got if r.toxic]
    assert np.mean(bad) > 0.85 and np.mean([r.predicted for r in got if not r.toxic]) < 0.02
    assert all(0 <= r.score <= 1 for r in got)


def test_toxicity_reads_disguise():
    plain_, masked, clean = (features(t, ({"moron": 3.0}, {})) for t in ("you are a moron", "you are a m0r0n", "you are a friend"))
    assert plain_[1] > 0 and plain_[7] > 0 and masked[16] > 0 and clean[1] == clean[16] == 0


def test_toxicity_of_odd_rows(odd, none, table):
    few = table("labels").filter("doc_id < 3")
    rows = toxicity(odd, few).collect()
    assert len(rows) == 14 and len({r.score for r in rows}) == 1  # too few labels: a constant
    rows = toxicity(table("documents").unionByName(odd, allowMissingColumns=True), table("labels")).collect()
    assert len(rows) == 214 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    assert toxicity(none, table("labels")).count() == 0


def test_network_gradients():
    net, x = byte_conv.new_net(), byte_conv.bytes_of("Some text, with ümlauts and more words. " * 30)
    loss = lambda: float(np.log1p(np.exp(byte_conv.logit(net, x))))
    for p, g in zip(net.parts(), byte_conv._gradients(net, x, 0.0)):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        kept = p[at]
        p[at] = kept + 0.01
        up = loss()
        p[at] = kept - 0.01
        down = loss()
        p[at] = kept
        assert abs((up - down) / 0.02 - g[at]) < 0.02 * abs(g[at]) + 1e-3


def test_network_reads_the_whole_text(monkeypatch):
    net = byte_conv.new_net()
    text = byte_conv.bytes_of("abc def " * 5000 + "%%% !!")
    whole = byte_conv.logit(net, text)
    monkeypatch.setattr(byte_conv, "PIECE", 64)
    assert abs(byte_conv.logit(net, text) - whole) < 1e-4
    assert byte_conv.logit(net, byte_conv.bytes_of("abc def " * 5000)) != whole


def test_quality_held_out(spark, docs):
    df = spark.read.parquet(f"{BIG}/documents.parquet")
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    got = quality(df, labels).join(labels, "doc_id").filter(held_out(4, 2)).select("quality", "score").collect()
    good, bad = [r.score >= 0.7 for r in got if r.quality], [r.score >= 0.7 for r in got if not r.quality]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.25


def test_quality_of_odd_rows(odd, none, table):
    rows = quality(odd.select("doc_id", "text").unionByName(table("documents").select("doc_id", "text")), table("labels")).collect()
    assert len(rows) == 214 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (2, 11)}) >= 1
    assert quality(none, table("labels")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header class="site"><h1>Site</h1></header>
<nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">We use cookies here</div><!-- no --><div id=sidebar><p>Aside text</p></div>
<main><article><h1>Head &amp; tail</h1><p>One <a href=x>link</a>\n two<br>three<p>&lt;b&gt; four &nbsp; five</p><div class="ad-box">Buy now</div>
<form><label>Mail</label></form><script>var p = "</p>";</script><p>Last.</p><section id="comments"><p>nice one</p></section></article></main>
<footer>&copy; us</footer></body></html>"""


def test_main_text():
    assert main_text(PAGE, block_tree()) == "Head & tail\n\nOne link two three\n\n<b> four five\n\nLast."
    assert [main_text(p, block_tree()) for p in (None, "", "  ", "<p></p>", "<!-- x", "<")] == ["", "", "", "", "", "<"]
    assert len(blocks_of("<p>a<p>b<div>c</div>d")) == 4
    blocks = blocks_of('<p>one</p><script>var a = "<!--", b = x<y="</script><p>two <a title="a > b">three</a></p>')
    assert [(b.text, b.linked) for b in blocks] == [("one", 0), ("two three", 1)]


def labelled_pages(kind, n=150, seed=5):
    r, x, y = np.random.default_rng(seed), [], []
    for _ in range(n):
        blocks, labels = labelled_page(r, kind < 4, kind in (0, 1, 4))
        if blocks:
            x.append(block_features(blocks))
            y += labels
    return np.concatenate(x), np.array(y)


def test_neighbours_decide_about_blocks():
    x, y = labelled_table()
    assert ((block_tree().predict(x) > 0) == (y > 0)).mean() > 0.99
    near = [FEATURES.index(c) for c in ("words_before", "links_before", "words_after", "links_after")]
    names = [FEATURES.index(c) for c in (*KINDS, "hidden", "apart", "within")]
    for kind in (0, 2, 4, 5):
        x, y = labelled_pages(kind)
        right = lambda z: ((block_tree().predict(z) > 0) == y).mean()
        mixed, bare = x.copy(), x.copy()
        mixed[:, near] = mixed[np.random.default_rng(1).permutation(len(x))][:, near]
        bare[:, names] = 0
        assert right(x) > 0.98 and right(mixed) < right(x) - 0.08
        assert right(bare) > 0.98 if kind == 5 else right(bare) < right(x)


@pytest.mark.parametrize("unit", ["<div class=main>x", '<a "', "<a ", '<a ">" x', "<a x=\">\"", "<svg>", "</div><section>", "</script", "<!--",
                                  "<script>", "<p class='x", "<div><p>text <a href=q>l</a></p>"])
def test_main_text_of_deep_and_unclosed_pages(unit):
    page = unit * (4_000_000 // len(unit)) + ">" + "<p>" + "the words at the end " * 5 + "</p>"
    start = time.process_time()
    main_text(page, block_tree())
    assert time.process_time() - start < 20  # 10 seconds on a slow machine; quadratic ones take hours


BODY = "<h1>A heading of the page</h1><p>" + "Some words of the article stand here. " * 8 + "</p><p>" + "And more of them follow. " * 9 + "</p>"
MENU = "<nav><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul></nav>"


@pytest.mark.parametrize("page", [
    f"<html><head><title>t</title><body>{MENU}<article>{BODY}</article></body></html>",
    f"<html><head><meta charset=utf-8><title>t</title><style>p {{}}</style>{MENU}<article>{BODY}</article>",
    f"<html><head><title>t</title></head><body><iframe src=x><article>{BODY}</article></body></html>",
    f"<body><form action=x>{MENU}<div>{BODY}</div></form></body>",
    f"<body><form action=x>{MENU}<article>{BODY}</article></form></body>",
    f"<body>{MENU}<div class='content has-sidebar'><article>{BODY}</article></div></body>",
    f"<body>{MENU}<article class='post tags-social'>{BODY}</article></body>",
])
def test_main_text_of_other_layouts(page):
    text = main_text(page, block_tree())
    assert text.startswith("A heading of the page\n\nSome words") and text.endswith("follow.") and "One" not in text


def test_parts_beside_the_article_stay_out():
    talk = "<p>" + "Someone says a thing about it. " * 60 + "</p>"
    page = f"<body><article>{BODY}</article><div class=comments><h2>Talk</h2>{talk}</div><div class=sidebar>{talk}</div><div hidden>{BODY}</div></body>"
    assert "Someone" not in main_text(page, block_tree()) and main_text(page, block_tree()).count("A heading") == 1


def test_main_text_of_pages(spark, table):
    got = {r.page_id: r for r in extract(table("pages")).collect()}
    for r in table("pages").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        import html
        parts = [" ".join(html.unescape(re.sub("</?b>", "", p)).split()) for p in re.split("</?p>|</?h1>|<br>", inner)]
        want = "\n\n".join(p for p in parts if p)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)
    odd = spark.createDataFrame([(1, None, None, 1), (None, "u", "<p>Some words stand here as they are.</p>", 2), (1, None, None, 1)],
                                "page_id long, url string, html string, text int").withColumn("n_chars", F.lit("x")).withColumn("words", F.lit(1))
    assert sorted((str(r.page_id), r.n_chars) for r in extract(odd).collect()) == [("1", 0), ("1", 0), ("None", 34)]
    assert extract(odd.filter("false")).count() == 0


RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://x.org", "HTTP://X.ORG/a", "https://www.Example.org/es/1?q#f", "https://example.org/en/123",
            "https://example.org/en/2", "https://notexample.org/es/1", "ftp://a.com/de/x/y", "http://a.com/fr?x", "http://a.com/fr/?x",
            "http://my-casino.net/", "http://casino.org/en/", "http://a.net/casino", "http://a.net?x://b.org/", "x://h.net/\n/", "http://a.com/de/x/y"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(None, "http://x.org/"), (1, "")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("x")).withColumn("token", F.lit("y"))
    got = judge_urls(df, [host_rule(*r) for r in RULES] + [name_rule("casino")]).collect()

    def plain_(u):
        rest = (u or "").partition("://")
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in re.split("[/?#]", rest[2])[0]) if rest[1] else ""
        path = re.match(r"[^/?#]*([^?#]*)", rest[2])[1] if rest[1] else ""
        fit = [(len(r), r, v) for r, v in RULES
               if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        named = re.search(r"(^|[.-])casino([.-]|$)", host)
        return (host, path, *(max(fit)[1:] if fit else (None, "block" if named else "allow")))

    assert sorted(map(str, [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got])) == sorted(str((i, *plain_(u))) for i, u in rows)
    assert judge_urls(df.filter("false"), [host_rule(*RULES[0])]).count() == 0
    assert judge_urls(df, []).filter("verdict = 'allow'").count() == len(rows)


def test_rules_without_tokens_and_many_rules(spark):
    rules = [host_rule("пример/", "block"), host_rule("пример/да/", "allow"), name_rule("ab-cd"), *registered_rules(), *registered_rules()[:9]]
    hosts = ["пример", "x.пример", "ab-cd.net", "x.ab-cd-e.net", "abcd.net", "my.free-bets.example.net", "spam.org", "a.com", "b.org"]
    paths = ["", "/", "/да/1", "/login", "/x/login/y", "/xlogin/", "/a/b.PDF", "/a/b.pdf", "/feed", "/de/1", "/fr/x.zip", "/a.pdf/b"]
    df = spark.createDataFrame([(i, f"http://{h}{p}") for i, (h, p) in enumerate((h, p) for h in hosts for p in paths)], "page_id long, url string")
    for many in (1_000_000, 1):  # broadcast or joined
        url_rules.BROADCAST_RULES, kept = many, url_rules.BROADCAST_RULES
        got = {r.page_id: (r.rule, r.verdict) for r in judge_urls(df, rules).collect()}
        url_rules.BROADCAST_RULES = kept
        for i, (h, p) in enumerate((h, p) for h in hosts for p in paths):
            fit = [(w, pattern, rule, verdict) for rule, pattern, _, verdict, w in rules if re.search(pattern, h + p)]
            assert got[i] == (max(fit)[2:] if fit else (None, "allow")), (h, p)
    assert judge_urls(df, [folder_rule("login")]).filter("verdict = 'block'").count() == 2 * len(hosts)
    assert judge_urls(df, [ending_rule("pdf")]).filter("verdict = 'block'").count() == len(hosts)


def plain_features(text, lexicon):
    """The dense features again, word by word."""
    words, starts = lexicon
    low = (text or "").lower()
    plain_ = re.findall(r"[^\W\d_]+", low)
    read = toxicity_words(text or "")[1]
    rows = []
    for i, w in enumerate(plain_):
        start = max([starts.get(w[:k], 0.0) for k in (4, 5) if len(w) > k] or [0.0])
        near = any(v in SECOND for v in plain_[max(0, i - 3):i + 4])
        rows.append((w in words, start > 0, max(words.get(w, 0.0), start), near, w in SECOND, w in INSULTS))
    n, chars, text = max(1, len(plain_)), max(1, len(text or "")), text or ""
    hit = [r for r in rows if r[0] or r[1]]
    return [np.log1p(len(plain_)), sum(r[0] for r in hit) / n, np.log1p(sum(r[0] for r in hit)), sum(r[1] for r in hit) / n,
            np.log1p(sum(r[1] for r in hit)), sum(r[5] for r in hit) / n, sum(r[2] for r in hit) / n, sum(r[3] for r in hit) / n,
            sum(r[4] for r in rows) / n, sum(c in CAPITALS for c in text) / chars,
            len(re.findall(r"\b[A-Z]{3,}\b", text)) / n, text.count("!") / n, text.count("?") / n,
            sum(bool(re.match(r"[^\w\s]", c)) for c in text) / chars, sum(c.isdecimal() for c in text) / chars, len(read) / n,
            sum(w in words for w in read) / n, len(re.findall(r"([^\W\d_])\1\1", text)) / n]


CAPITALS = {chr(c) for c in [*range(65, 91), *range(0xC0, 0xD7), *range(0xD8, 0xDF)]}


def test_toxicity_features_against_a_plain_version(docs):
    lexicon = split_lexicon({**dict.fromkeys(INSULTS, 2.5), "the": 1.0, "ther-": 3.0, "thing-": 2.0, "en": 0.5})
    for r in docs.limit(60).collect():
        assert np.allclose(features(r.text, lexicon), plain_features(r.text, lexicon)), r.doc_id
    for text in ("", None, "YOU stupid MORON!!! why??", "st*pid sooo b4d", "stupid du trottel"):
        assert np.allclose(features(text, lexicon), plain_features(text, lexicon))


def test_toxicity_curve_on_rows_it_has_not_seen(spark):
    df, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity(df, labels).join(labels, "doc_id").filter(held_out(5, 0)).select("toxic", "score").toPandas()
    for low, high in ((0.0, 0.2), (0.2, 0.5), (0.5, 0.8), (0.8, 1.01)):
        part = rows[(rows["score"] >= low) & (rows["score"] < high)]
        if len(part):  # the mean score lies within the error of the share of toxic rows
            error = 3 * np.sqrt(max(part["score"].mean() * (1 - part["score"].mean()), 0.01) / len(part)) + 0.03
            assert abs(part["score"].mean() - part["toxic"].mean()) < error, (low, len(part))


def test_labels_of_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    one = sample_labelled(docs, labels, "toxic", 100, 5, 9).collect()
    two = sample_labelled(docs.repartition(3), labels, "toxic", 100, 5, 9).collect()
    assert sorted(map(str, one)) == sorted(map(str, two)) and sorted((r.doc_id, r.label) for r in one) == [(1, 1), (2, 1)]


def plain_logit(net, x):
    relu = lambda v: np.maximum(v, 0)
    windows = [np.concatenate([net.embed[b] for b in x[i:i + 8]]) @ net.filters for i in range(0, len(x) - 7, 4)]
    segs = [relu(np.max(windows[i:i + 16], axis=0) + net.bias) for i in range(0, len(windows), 16)]
    chunks, at = [], 0
    while True:
        chunks.append(np.max(segs[at:at + 4], axis=0))
        if at + 4 >= len(segs):
            break
        at += 3
    return float(np.concatenate([np.max(chunks, axis=0), np.mean(chunks, axis=0)]) @ net.out + net.base[0])


def test_training_texts_are_bounded(table):
    rows = byte_conv.training_rows(table("documents"), table("labels"), 4000, 60_000, 4, 2)
    whole = byte_conv.training_rows(table("documents"), table("labels"), 4000, 1 << 30, 4, 2)
    assert 0 < len(rows) < len(whole) and sum(len((t or "").encode()) for t in rows["text"]) <= 60_000


def test_network_against_a_plain_forward_pass():
    net, rng = byte_conv.new_net(), np.random.default_rng(3)
    for p in net.parts():
        p += rng.normal(0, 0.1, p.shape).astype(np.float32)
    for text in ("", "short", "Some longer text with ümlauts. " * 40):
        x = byte_conv.bytes_of(text)
        assert abs(byte_conv.logit(net, x) - plain_logit(net, x)) < 1e-3


def test_sigmoid_is_bounded():
    assert 0 < sigmoid(np.array([-1e9]))[0] < sigmoid(np.array([1e9]))[0] <= 1


@pytest.mark.parametrize("column", ["score", "label", "kept"])
def test_clashing_columns_do_not_leak(odd, column):
    assert [f.dataType.typeName() for f in repetition(odd).schema if f.name == "kept"] == ["boolean"]
    assert column in odd.columns
