import math
import random

from paysleuth.llm import language

WORDS = {"en": "the and of that with there which", "de": "der und nicht auch eine schon über", "fr": "les des une avec être où déjà"}


def test_evidence_is_fused(spark):
    docs = [(i, (WORDS[k] + " ") * 8, k, f"s{k}") for i, k in enumerate(list(WORDS) * 12)]
    docs += [(900, None, None, "sde"), (901, "", "", None), (None, WORDS["fr"], None, "sfr")]
    pages = [(i, f"http://www.h{k}.example.com/{i}", f'<html lang="{k}"><body>{WORDS[k]}</body></html>') for i, k in enumerate(list(WORDS) * 9)]
    pages += [
        (500, "http://hde.example.com/none", "<html><script>the and of that</script></html>"),  # the host decides
        (501, "http://new.example.com/", '<html lang="fr"></html>'),  # the markup decides
        (502, "http://other.de/", None),  # the address decides
        (503, None, "<html lang=de><p>the and of that with there which the and that</p></html>"),  # the text decides
        (504, "http://hfr.example.com/", f"<nav>{WORDS['de']}</nav><p>{WORDS['fr']}</p>"),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    p = spark.createDataFrame([(*x, "c") for x in pages], "page_id long, url string, html string, host string")
    got = language.identify(d, p).collect()
    assert len(got) == len(docs) + len(pages)
    by_page = {r["page_id"]: r for r in got if r["page_id"] is not None}
    assert all(by_page[i]["lang"] == k for i, k in enumerate(list(WORDS) * 9))
    assert [by_page[i]["lang"] for i in (500, 501, 502, 504)] == ["de", "fr", "de", "fr"]
    assert by_page[503]["text_lang"] == "en"
    by_doc = {r["doc_id"]: r for r in got if r["page_id"] is None}
    assert by_doc[900]["lang"] == "de" and by_doc[None]["lang"] == "fr"
    assert all(0 < r["confidence"] <= 1 for r in got)


def test_nothing_known(spark):
    d = spark.createDataFrame([(1, "x", None, "s")], "doc_id long, text string, lang string, source string")
    p = spark.createDataFrame([(1, "http://a.de/", "<p>x</p>")], "page_id long, url string, html string")
    assert [r["lang"] for r in language.identify(d, p).collect()] == [None, None]
    assert language.identify(d.limit(0), p.limit(0)).count() == 0


def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, rest = docs.filter("doc_id % 3 != 0"), docs.filter("doc_id % 3 = 0")
    languages, counts = language.trigram_counts(train)
    rows = language.document_rows(spark, rest, language.log_likelihoods(counts))
    got = language.fuse(rows, languages).join(rest.selectExpr("doc_id as id", "lang as truth"), "id")
    right = got.selectExpr("avg(cast(lang = truth as double)) as a").first()["a"]
    assert right > 0.97


def test_rare_languages_are_learned_too(spark):
    """70 languages; the rarest five of them have one document each."""
    names = [f"l{k:02d}" for k in range(70)]
    text = {k: " ".join(f"{a}{k[1:]}{b}" for a in "abcde" for b in "vwxyz") for k in names}
    docs = [(i, text[k], k, f"s{k}") for i, k in enumerate(k for k in names for _ in range(1 if k >= "l65" else 2))]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    languages, counts = language.trigram_counts(d)
    assert languages == names and (counts.sum(1) > 0).all()
    p = spark.createDataFrame([(1, None, None)], "page_id long, url string, html string")
    got = {r["doc_id"]: r["text_lang"] for r in language.identify(d, p).collect() if r["page_id"] is None}
    assert got == {i: k for i, _, k, _ in docs}


def plain_fusion(rows, names):
    """The posterior of each row by sums over plain lists."""
    n = len(names)

    def softmax(scores):
        top = max(scores)
        parts = [math.exp(x - top) for x in scores]
        return [p / sum(parts) for p in parts]

    soft = [softmax([e * language.TEMPER for e in r["evidence"]]) for r in rows]
    base = [(sum(s[i] for s in soft) + 1) / (len(rows) + n) for i in range(n)]
    result = []
    for r, own in zip(rows, soft, strict=True):
        def others(key):
            same = [s for q, s in zip(rows, soft, strict=True) if q is not r and q[key] is not None and q[key] == r[key] and (key not in ("host", "domain") or q["kind"] == r["kind"])]
            return [sum(s[i] for s in same) for i in range(n)], len(same)

        final = []
        for i in range(n):
            domain = base[i]
            if r["domain"] is not None:
                sums, count = others("domain")
                domain = (sums[i] + language.STRENGTH * base[i]) / (count + language.STRENGTH)
            sums, count = others("host")
            prior = (sums[i] + language.STRENGTH * domain) / (count + language.STRENGTH) if r["host"] is not None else domain
            score = r["evidence"][i] * language.TEMPER + math.log(max(prior, 1e-6))
            for key in ("declared", "suffix"):
                if r[key] is not None:
                    whole = sum(s[i] for q, s in zip(rows, soft, strict=True) if q[key] is not None and q is not r)
                    kinds = len({q[key] for q in rows if q[key] is not None})
                    before = 0.5 + (language.STRENGTH if r[key] == names[i] else 0.0)
                    p = (others(key)[0][i] + before) / (whole + language.STRENGTH + 0.5 * (kinds + 1))
                    score += math.log(max(p, 1e-6))
            final.append(score)
        posterior = softmax(final)
        result.append((r["id"], names[posterior.index(max(posterior))], max(posterior)))
    return result


def test_fusion_equals_plain_code(spark):
    rng = random.Random(15)
    names = ["de", "en", "fr"]
    rows = []
    for i in range(120):
        page = rng.random() < 0.6
        domain = rng.choice(["a.de", "b.com", "c.fr"]) if page else None
        rows.append({
            "kind": "page" if page else "document",
            "id": i,
            "host": (rng.choice(["x.", "y."]) + domain) if page else rng.choice(["s1", "s2", "s1", "s1"]),
            "domain": domain,
            "suffix": domain.split(".")[1] if page else None,
            "declared": rng.choice([None, "de", "en", "xx"]) if page else None,
            "evidence": [rng.gauss(0, 15) for _ in names],
        })
    df = spark.createDataFrame(rows, "kind string, id long, host string, domain string, suffix string, declared string, evidence array<double>").repartition(3)
    got = {r["id"]: (r["lang"], r["confidence"]) for r in language.fuse(df, names).collect()}
    assert len(got) == 120
    for i, lang, confidence in plain_fusion(rows, names):
        assert got[i][0] == lang and abs(got[i][1] - confidence) < 1e-6


def test_repeats_ties_and_long_texts(spark):
    docs = [(1, "der und nicht " * 40_000, "de", "s"), (2, "the and of " * 5, "en", "s"), (2, "the and of " * 5, "en", "s"), (3, "", None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    p = spark.createDataFrame([(1, "http://a.b/", "<p>the and of</p>")], "page_id long, url string, html string")
    got = language.identify(d, p).collect()
    by = [(r["doc_id"], r["text_lang"]) for r in got if r["page_id"] is None]
    assert sorted(x for x in by if x[0] < 3) == [(1, "de"), (2, "en"), (2, "en")] and len(got) == 5
    assert dict(by)[3] == "de"  # no evidence: the first in the alphabet
