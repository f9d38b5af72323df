from pyspark.sql import functions as F

from heliogrid.llm import langid
from tests.llm import common

RULE = langid.LanguageRule(min_declared=3)
SAMPLES = {
    "en": "the quick brown fox jumps over the lazy dog and then it runs through the thick woods with all of its friends",
    "de": "der schnelle braune Fuchs springt über den faulen Hund und läuft dann mit seinen Freunden durch den dichten Wald",
    "fr": "le renard brun rapide saute par-dessus le chien paresseux et court ensuite avec tous ses amis dans la forêt épaisse",
}
ROWS = "doc_id long, text string, lang string, source string, fits string, best string, votes int, prior string"


def rows(spark, data):
    return spark.createDataFrame([(i, *r, "x", "y", 1, "z") for i, r in enumerate(data)], ROWS)


def identify(df, rule=RULE):
    return langid.identify(langid.evidence(df, "doc_id", F.col("text"), F.col("lang"), F.col("source")), rule)


def corpus():
    out = []
    for k, (lang, text) in enumerate(SAMPLES.items()):
        words = text.split()
        out += [(" ".join(words[i % 9 :] + words[: i % 9]), lang, f"http://www.h{i % 3}.{lang}/a/{i}") for i in range(30)]
    return out


def test_text_outweighs_a_wrong_declaration(spark):
    data = corpus() + [(SAMPLES["de"], "en", "http://h0.en/x"), (SAMPLES["fr"].upper(), None, None), (SAMPLES["en"], "xx-YY", "nowhere")]
    got = {r.doc_id: r for r in identify(rows(spark, data)).collect()}
    assert all(got[i].lang == lang and got[i].accepted for i, (_, lang, _) in enumerate(corpus()))
    assert [got[90 + i].lang for i in range(3)] == ["de", "fr", "en"]


def test_declaration_and_host_decide_where_the_text_says_little(spark):
    data = corpus() + [("a", "de", "http://h1.de/q"), ("a", "fr", "http://h1.fr/q"), ("a", None, "http://www.h2.de/q"), ("a", "", "http://other.fr/q")]
    got = {r.doc_id: r.lang for r in identify(rows(spark, data)).collect()}
    assert [got[90 + i] for i in range(4)] == ["de", "fr", "de", "fr"]


def test_rejects_what_has_no_language(spark):
    data = corpus() + [("123 456 *** !!", "en", "h0.en"), ("", "en", "h0.en"), (None, None, None), ("zqxj vkqz jxqw qzvk xjqz wvqx kzjq " * 5, None, "z")]
    got = {r.doc_id: r for r in identify(rows(spark, data)).collect()}
    assert [got[90 + i].lang for i in range(4)] == ["und"] * 4 and not any(got[90 + i].accepted for i in range(4))
    only = identify(rows(spark, corpus()), langid.LanguageRule(min_declared=3, languages=("de",))).where("accepted")
    assert only.count() == 30


def test_parts_of_an_address(spark):
    df = spark.createDataFrame([("HTTPS://News.Example.co.UK:80/a.b?c",), ("src7",), (None,), ("",), ("http://[::1]/",)], "a string")
    got = [(r.h, r.s) for r in df.select(langid.host_of(F.col("a")).alias("h")).withColumn("s", langid.suffix_of(F.col("h"))).collect()]
    assert got[:4] == [("news.example.co.uk", "uk"), ("src7", ""), ("", ""), ("", "")]


def test_awkward_rows(spark):
    got = identify(common.messy(spark), langid.LanguageRule(min_declared=1)).collect()
    assert len(got) == 12 and all(r.lang == "und" and not r.accepted for r in got if r.doc_id in (3, 4, 5))
    assert identify(common.empty(spark)).count() == 0
    undeclared = identify(common.messy(spark), langid.LanguageRule(min_declared=1000)).collect()
    assert len(undeclared) == 12 and not any(r.accepted for r in undeclared)


def test_test_data(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = identify(docs, langid.LanguageRule()).withColumnRenamed("lang", "told").join(docs.select("doc_id", "lang"), "doc_id")
    assert got.where("told = lang and accepted").count() >= 0.98 * docs.count()


def by_hand(data, rule):
    """What identify() tells of rows (text, declared, address), from its definition, a row at a time."""
    import math
    import re
    from collections import Counter

    def codes(text):
        letters = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in b" " + (text or "").encode() + b" ")
        plain = re.sub(b" +", b" ", letters)
        return [((plain[i] << 16 | plain[i + 1] << 8 | plain[i + 2]) * 2654435761 % 2**32) >> (32 - rule.buckets_log2) for i in range(len(plain) - 2)]

    rows = []
    for text, declared, address in data:
        said = re.match("[A-Za-z]+", (declared or "").strip(" "))
        host = re.match(r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#:]+)", address or "")
        host = host[1].lower() if host else ""
        suffix = re.search(r"\.([^.]+)$", host)
        rows.append((codes(text), said[0].lower() if said else "", host, suffix[1] if suffix else ""))
    seen = Counter(r[1] for r in rows)
    names = sorted(n for n, c in seen.items() if n and c >= rule.min_declared)
    width = 2**rule.buckets_log2
    counts = {n: Counter(b for r in rows if r[1] == n for b in r[0]) for n in names}
    log = lambda n, b: math.log((counts[n][b] + rule.alpha) / (sum(counts[n].values()) + rule.alpha * width))
    fits = [[rule.temper * sum(log(n, b) for b in r[0]) for n in names] + [-rule.temper * len(r[0]) * math.log(width)] for r in rows]
    best = [max(range(len(names)), key=lambda i: f[i]) if r[0] else -1 for r, f in zip(rows, fits)]
    value = lambda said: said if said in names or said == "" else "*"
    table = {v: [1 + sum(b == i and value(r[1]) == v for r, b in zip(rows, best)) for i in range(len(names))] for v in [*names, "", "*"]}
    per_language = [sum(t[i] for t in table.values()) for i in range(len(names))]
    total = sum(per_language)
    out = []
    for r, f, b in zip(rows, fits, best):
        votes = lambda keep: [sum(x == i for q, x in zip(rows, best) if keep(q)) for i in range(len(names))]
        smooth = lambda n, above, weight: [(x + weight * p) / (sum(n) + weight) for x, p in zip(n, above)]
        overall = [x / total for x in per_language]
        host = votes(lambda q: q[2] == r[2])
        above = smooth(votes(lambda q: q[3] == r[3]), overall, rule.suffix_weight) if any(host) else overall
        prior = smooth([max(n - (i == b), 0) for i, n in enumerate(host)], above, rule.host_weight)
        prior = [p * (1 - rule.und_prior) for p in prior] + [rule.und_prior]
        v = value(r[1])
        says = [0.0] * (len(names) + 1) if v == "" else [math.log(table[v][i] / per_language[i]) for i in range(len(names))]
        if v != "":
            says.append(math.log(sum(table[v]) / total))
        else:
            says[-1] = 0.0
        logs = [a + s + math.log(p) for a, s, p in zip(f, says, prior)]
        top = max(logs)
        lang = [*names, langid.UND][logs.index(top)] if r[0] else langid.UND
        confidence = 1 / sum(math.exp(x - top) for x in logs)
        out.append((lang, confidence, names[b] if b >= 0 else None, lang != langid.UND and confidence >= rule.min_confidence))
    return out


def test_equals_the_definition(spark):
    words = [w for t in SAMPLES.values() for w in t.split()]
    mixed = [(" ".join(words[i : i + 6]), ["en", "de", None, "xx", "fr-CA"][i % 5], f"http://h{i % 4}.{['en', 'de', 'com'][i % 3]}/p") for i in range(0, 50, 2)]
    data = corpus() + mixed + [("", "en", "h0.en"), (None, None, None), ("12 !!", "de", "http://h1.de/"), ("a b", " EN", "x"), ("ÜBER ñ", "qq", "http://h9.zz/")]
    got = {r.doc_id: r for r in identify(rows(spark, data)).collect()}
    for i, (lang, confidence, text_lang, accepted) in enumerate(by_hand(data, RULE)):
        r = got[i]
        assert (r.lang, r.text_lang, r.accepted) == (lang, text_lang, accepted) and abs(r.confidence - confidence) < 1e-3


def test_pages_without_and_with_odd_markup(spark, tmp_path):
    """Null, empty, unclosed and very long pages: only text between tags and the page's own attribute count."""
    from heliogrid.llm import queries

    wrap = lambda lang, text: f'<!doctype html><HTML class=x LANG="{lang}"><head><style>p {{ the quick }}</style><script>var fox = "the lazy";</script></head><body><p>{text}</p></body></html>'
    bodies = [(wrap(lang, text), f"http://h.{lang}/{i}") for i, (text, lang, _) in enumerate(corpus())]
    odd = [None, "", "<html lang=de", "<p", wrap("en", SAMPLES["de"]), wrap("fr", SAMPLES["fr"] * 3000), "<html lang='fr'><body>" + SAMPLES["fr"], "no tags <b but " + SAMPLES["en"]]
    table = spark.createDataFrame([(i, u, b, 1) for i, (b, u) in enumerate(bodies + [(o, f"http://odd.de/{k}") for k, o in enumerate(odd)])], "page_id long, url string, html string, lang int")
    table.write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in queries.language_id_pages(spark, str(tmp_path)).collect()}
    assert len(got) == 98 and all(got[i].lang == lang for i, (_, lang, _) in enumerate(corpus()))
    # an unclosed tag is text, and its attribute declares
    assert [got[90 + k].lang for k in (0, 1, 2, 4, 5, 6, 7)] == ["und", "und", "de", "de", "fr", "fr", "en"]
    assert queries.language_id_pages(spark, str(tmp_path)).count() == 98
