import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.llm import langid, pii, tagger, toxicity

WORDS = {"en": "the of and that house river stone water wood", "de": "der die und nicht straße wasser holz über", "fr": "le la et être maison rivière eau pierre forêt"}


def corpus(n=240):
    rng, rows = np.random.default_rng(1), []
    for k in range(n):
        lang = sorted(WORDS)[k % 3]
        rows.append((k, " ".join(rng.choice(WORDS[lang].split(), 12)), lang))
    return rows


def test_language_of_held_out_rows_and_edges(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.filter("doc_id < 160"))
    got = langid.identify(df.filter("doc_id >= 160"), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "123 !?", "x"), (4, "wasser " * 30_000, "x"), (None, "der wald", None)], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, 4, None)] == ["und", "und", "und", "de", "de"] and got[1].score == 0.0
    kept = langid.filter_language(odd, model)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["4", "None"]
    strict = langid.fit(df.filter("doc_id < 160"), ranges=True)
    foreign = [(5, "это совсем другой язык без общих букв", "x"), (6, "qqq zzz xxq zqx qzx xqz zzq qxx zxq", "x"), (7, "das wasser und der wald", "x"), (8, "вода", "x")]
    more = odd.union(spark.createDataFrame(foreign, odd.schema))
    # too few letters to be judged by likelihood: 8 stays
    assert {r.doc_id for r in langid.filter_language(more, strict).collect()} >= {7, None} and not {1, 2, 3, 5, 6} & {r.doc_id for r in langid.filter_language(more, strict).collect()}
    bare = langid.fit(df.limit(0), ranges=True)
    assert {r.doc_id for r in langid.filter_language(more, bare).collect()} == {4, 5, 6, 7, 8, None}
    assert langid.identify(odd.limit(0), model).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, langid.fit(df.limit(0))).collect()} == {"und"}


def test_language_is_fitted_on_all_rows(spark):
    """Every labelled row counts, also of large tables, of languages with one text and of repeated rows."""
    many = spark.range(13_000).selectExpr("id AS doc_id", "concat('wort', id) AS text", "if(id < 3000, 'de', 'en') AS lang").union(
        spark.createDataFrame([(k, f"mot{k}", f"x{k:03d}") for k in range(100)] + [(1, "wort1", "de"), (2, "wort2", None), (3, None, "en")], "doc_id long, text string, lang string"))
    model = langid.fit(many.repartition(3), ranges=True)
    assert model.languages == ["de", "en"] + [f"x{k:03d}" for k in range(100)]
    assert np.allclose(np.exp(model.log_prior), np.array([3002, 10_001] + [2] * 100) / 13_203)


def plain_grams(text):
    """Buckets of a text by plain loops over its characters, straight from the definition."""
    clean, gap = "  ", False
    for ch in (text or "").lower():
        if ch.isalpha():
            clean, gap = clean + ch, True
        elif gap:
            clean, gap = clean + " ", False
    clean += " "
    out = []
    for k in (1, 2, 3):
        for i in range(len(clean)):
            h = 0
            for ch in (clean + "   ")[i : i + k]:
                h = (h * 1_000_003 + ord(ch) + 1) % 2**32
            out.append(((h + k - 1) * 0x9E3779B97F4A7C15 % 2**64) >> 48)
    return out


def test_fit_and_scores_from_scratch(spark):
    rows = corpus(60) + [(60, None, "de"), (61, "", "fr"), (62, "x", None)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts = {lang: [0] * 2**16 for lang in WORDS}
    docs = dict.fromkeys(WORDS, 0)
    for _, text, lang in rows:
        if text is not None and lang is not None:
            docs[lang] += 1
            for b in plain_grams(text):
                counts[lang][b] += 1
    assert model.languages == sorted(WORDS)
    texts = [t for _, t, _ in rows[:9]] + ["Ein Wort!", "ünïcödé 漢字 der", "a", "the  river,\n\nla maison"]
    assert [model.score([t]) for t in texts] == [([a], [b]) for a, b in zip(*model.score(texts))]
    for text, lang, score in zip(texts, *model.score(texts)):
        grams = plain_grams(text)
        logs = {}
        for k, c in counts.items():
            total = sum(c) + 0.5 * 2**16
            logs[k] = np.log((docs[k] + 1) / (sum(docs.values()) + len(docs))) + sum(np.log((c[b] + 0.5) / total) for b in grams)
        letters = sum(ch.isalpha() for ch in text.lower())
        best = max(sorted(logs), key=logs.get)
        tempered = {k: (v - logs[best]) * min(1.0, 60 / letters) for k, v in logs.items()}
        assert lang == best and abs(score - 1 / sum(np.exp(v) for v in tempered.values())) < 1e-3


def naive_base(text):
    pats = {0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 1: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 2: r"[0-9]([\x20-]?[0-9])+", 3: r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, p in pats.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == 2 and not (16 <= len(d) <= 19 and pii.luhn(d)):
                continue
            if kind == 3 and not 8 <= len(d) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_patterns_against_plain_regexes():
    rng = np.random.default_rng(3)
    pieces = ["a.b@c.de", "x@y", "@@", "a@b.c@d.e", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (476) 555-2313", "+1+2 3456789", "+", "٣", "é", " ", "-", "12", "0", ".", "..", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces, rng.integers(1, 9)))
        assert pii.base_spans(text) == naive_base(text), text


def test_long_runs_take_no_time():
    assert pii.base_spans("a" * 300_000 + "@") == [] and pii.base_spans("1." * 100_000) != [] and pii.base_spans("9" * 200_000) == []


def test_gradients_and_accuracy():
    rng = np.random.default_rng(1)
    t = tagger.Tagger(embed=4, hidden=3)
    t.p = {k: v.astype(float) for k, v in t.p.items()}
    x, y = tagger.batch(rng, 2)
    _, g = t.gradients(x, y)
    for k in ("xf", "hb", "out", "trans"):
        i = tuple(rng.integers(0, s) for s in t.p[k].shape)
        old, e = t.p[k][i], 1e-4
        t.p[k][i] = old + e
        up, _ = t.gradients(x, y)
        t.p[k][i] = old - e
        down, _ = t.gradients(x, y)
        t.p[k][i] = old
        assert abs((up - down) / (2 * e) - g[k][i]) < 1e-2
    model = tagger.trained()
    x, y = tagger.batch(np.random.default_rng(77), 200)
    tags, sure = model.decode(x)
    assert (tags == y).mean() > 0.97 and sure.min() >= 0 and sure.max() <= 1 + 1e-6
    # the bound that spares most windows the search for the best path never changes the path
    em = model.emissions(x)
    assert (model.best_path(em) == tags).all() and len(model.open_rows(em)) < len(em)


def held_out_text(rng):
    """Sentences of another making than the training texts: other words, forms and surroundings."""
    fake = ["Please write to {} before Friday", "Server {} did not answer twice", "Paid with {} at the counter", "Ring {} in the morning", "See chapter 12 of 2019, p. 33", "The ratio was 3.14 to 1.5",
            "Version 10.2.1 fixed 47 faults", "It cost 1,250 dollars in 1998", "We met at 10:45 on 03/04/2017", "Order no. 55213 was late", "Nothing of note happened that day", "Les enfants jouaient dans le jardin"]
    makers = [lambda: (0, f"{rng.choice(['anna', 'p.miller', 'info', 'j_doe77'])}{rng.choice(['@', ' [at] ', '(at)'])}{rng.choice(['post', 'uni-bonn', 'shop24'])}.{rng.choice(['de', 'org', 'net'])}"),
              lambda: (1, ".".join(str(rng.integers(0, 256)) for _ in range(4))),
              lambda: (2, rng.choice([" ", "-", "."]).join(["4539", "1488", "0343", "6467"])),
              lambda: (3, rng.choice(["+49 30 {} {}", "+1 (212) {}-{}", "(415) {}-{}", "212-{}-{}"]).format(rng.integers(200, 999), rng.integers(1000, 9999)))]
    text, spans = "", []
    for _ in range(6):
        s = str(rng.choice(fake))
        if "{}" in s:
            kind, v = makers[fake.index(s)]()
            spans.append((kind, len(text) + s.index("{"), len(text) + s.index("{") + len(v)))
            s = s.replace("{}", v)
        text += s + rng.choice([". ", ".\n", "; "])
    return text, spans


def test_spans_of_texts_of_another_making():
    rng = np.random.default_rng(3)
    made = [held_out_text(rng) for _ in range(300)]
    got = pii.find(tagger.trained(), [t for t, _ in made])
    hit = sum(any(k == s[0] and a < s[2] and s[1] < b for k, a, b in all_) for (_, spans), (_, all_) in zip(made, got) for s in spans)
    right = [any(k == s[0] and a < s[2] and s[1] < b for s in spans) for (_, spans), (_, all_) in zip(made, got) for k, a, b in all_]
    assert hit / sum(len(s) for _, s in made) > 0.9 and np.mean(right) > 0.9
    alone = [set(pii.reconcile(h)) for h in pii.tagged(tagger.trained(), [t for t, _ in made])]
    base = [s for (t, _), _ in zip(made, got) for s in pii.base_spans(t)]
    assert sum(s in a for (t, _), a in zip(made, alone) for s in pii.base_spans(t)) / len(base) > 0.85


def test_spans_added_and_kept_and_redacted(spark):
    text = "Call +1 (476) 555-2313 or (476) 555-2313, mail a.b@x.example.com, or bob [at] site [dot] com, version 2.0, year 2024-01-05."
    base, all_ = pii.find(tagger.trained(), [text])[0]
    assert set(base) <= set(all_) and len(all_) > len(base)
    assert pii.find(tagger.trained(), [None, "", "no numbers here"]) == [([], [])] * 3
    df = spark.createDataFrame([(1, text, len(text)), (2, None, 0), (1, "x", 1)], "doc_id long, text string, n_chars long")
    got = {r.text: r for r in pii.redact_pii(df, length_col="n_chars").collect()}
    red = next(t for t in got if t and "[EMAIL]" in t)
    assert "[PHONE]" in red and "@" not in red and got[red].n_chars == len(red) and None in got and "2024-01-05" in red
    found = pii.find_pii(df).collect()
    assert len(found) == 3 and pii.find_pii(df.limit(0)).count() == 0


def test_reconciling_takes_the_heaviest_disjoint_spans():
    c = {(0, 0, 5): 2.0, (0, 4, 9): 3.0, (1, 9, 12): 1.0, (1, 0, 3): 1.5}
    assert pii.reconcile(c) == [(1, 0, 3), (0, 4, 9), (1, 9, 12)]


def tox_rows(n=600):
    rng, rows = np.random.default_rng(4), []
    vocabulary = [f"{a}{b}{c}" for a in ("ba", "ko", "li", "mo", "nu") for b in ("ta", "ri", "so", "we") for c in ("n", "s", "l", "")]
    for k in range(n):
        bad = int(k % 5 == 0)
        words = list(rng.choice(vocabulary, 30))
        if bad:
            at = int(rng.integers(30))
            words[at:at] = [str(rng.choice(["the", "of", "eine", "les"])), "grumpf" + str(rng.choice(["a", "el", "os"]))]
        rows.append((k, " ".join(words), bad))
    return rows


def test_toxicity_learns_stems_and_holds_out(spark):
    df = spark.createDataFrame(tox_rows(), "doc_id long, text string, toxic int")
    model = toxicity.learn(df.filter("doc_id < 400"))
    assert any("grumpfa".startswith(s) for s in model.stems)
    got = toxicity.score_toxicity(df.filter("doc_id >= 400"), model, clauses_out="why").collect()
    assert all((r.score >= 0.3) == bool(r.toxic) for r in got) and all(bool(r.why) == bool(r.toxic) for r in got)
    odd = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (3, "a grumpfa " * 5000, 1.0)], "doc_id long, text string, score double")
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(odd, model).collect()}
    assert got[1] == got[2] < 0.3 < got[3] <= 1
    assert not toxicity.learn(df.limit(0)).stems and not toxicity.learn(df.filter("toxic = 0")).stems


def test_grammar_weighs_clauses():
    m = toxicity.ToxicityModel({"idiot": 4.0})
    w = lambda t: sum(x for _, x in m.clauses(t))
    plain = w("such an idiot")
    assert w("you are an idiot") > plain > w("he said such an idiot") > 0 and w("not an idiot") < plain
    assert w("they will kill") > 0 == w("kill the process") == w("nothing") and w("kill you") > 0
    assert w("not here. an idiot") == w("not here, an idiot") == plain and w("no words but an idiot") == plain
    assert w("\u201can idiot\u201d") < w("an idiot") and w("such idiots") == plain > w("two words of idiot here") > 0
    # the context decides whether a word counts at all
    assert w("idiot") == w("idiot. idiot") == w("one idiot two three") == w("house tree idiot house") == 0
    assert w("idiot!") > 0 and w("idiot, come here") > 0 and w("idiots are many") > 0 and w("stupid idiot") == 0 < w("idiot idiot")


def plain_matches(model, text):
    """The grammar by looking around each word, without any machine."""
    out = []
    for clause, end in re.findall(r"([^.!?;\n]*)([.!?;\n]*)", text.lower()):
        tokens = [(t, *model.symbol(t)) for t in re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"\u201c\u201d\u00ab\u00bb\u201e]|[,:]", clause)]
        if not any(s in "IT" for _, s, _ in tokens):
            continue
        tokens += [("!", "!", 0.0)] * ("!" in end)
        kinds = [None] * len(tokens)
        eaten = set()  # targets that a threat took
        for k, (_, s, _) in enumerate(tokens):
            if s == "T":
                for j in range(k - 1, max(k - 6, -1), -1):
                    if tokens[j][1] in "BR":
                        j = -1
                        break
                    if tokens[j][1] in "FG":
                        break
                else:
                    j = -1
                if j >= 0:
                    kinds[k] = "t"
                    continue
                for j in range(k + 1, min(k + 4, len(tokens))):
                    if tokens[j][1] == "T":
                        break
                    if tokens[j][1] == "G":
                        kinds[j] = "t"
                        eaten.add(j)
                        break
        reach = toxicity.GOVERNS
        where = [k for k, (_, s, _) in enumerate(tokens) if s == "I"]
        addressed = set()
        for k in where:
            for j in range(k - 1, max(k - 6, -1), -1):
                if tokens[j][1] == "R":
                    break
                if tokens[j][1] == "G" and j not in eaten:
                    addressed.add(k)
                    break
            first = k == 0 or tokens[k - 1][1] in "P!Q"
            kind = None
            for j in range(k - 1, max(k - 1 - reach, -1), -1):
                s = tokens[j][1]
                if s in "P!Q":
                    break
                if s == "I":  # one at the start reaches the next word only
                    kind = "m" if k - j == 1 or not (j == 0 or tokens[j - 1][1] in "P!Q") else None
                    break
                if s in "CL":
                    kind = "p" if s == "C" else "m"
                    break
            kinds[k] = "d" if k in addressed else kind
            if kind is None:
                for j in range(k + 1, min(k + 1 + reach, len(tokens))):
                    s = tokens[j][1]
                    if first and j == k + 1 and s in "P!":
                        if k not in addressed:
                            kinds[j] = "x"
                        break
                    if s in "P!QI":
                        break
                    if s in "CL":
                        if k not in addressed:
                            kinds[j] = "h"
                        break
        waits = None
        for k, (_, s, _) in enumerate(tokens):
            if s == "I":
                waits = None if k in addressed else k
            elif s == "G" and k not in eaten:
                if waits is not None and k - waits <= 3:
                    kinds[k] = "a"
                waits = None
        for k, kind in enumerate(kinds):
            if kind is None:
                continue
            negated = False
            for j in range(k - 1, max(k - 5, -1), -1):
                if tokens[j][1] == "P" or kinds[j] is None and tokens[j][1] == "B":
                    break
                if kinds[j] is None and tokens[j][1] == "N":
                    negated = True
                    break
            told = any(s == "R" for _, s, _ in tokens[:k]) or sum(s == "Q" for _, s, _ in tokens[:k]) % 2
            odds = next(x for _, _, x in tokens[k::-1] if x)
            out.append((kind + "-" * negated + "'" * bool(told), odds))
    return out


def test_machine_against_looking_around():
    rng = np.random.default_rng(5)
    model = toxicity.ToxicityModel({"idiot": 4.0, "scum": 2.5}, {k: 0.1 + i / 7 for i, k in enumerate(toxicity.CELLS)}, -2.0, 1.5)
    words = "idiot scum idiots kill killed destroy you they not never said wrote is a the will must but however house tree river of with , : \" . ! \n töten dich".split(" ")
    for _ in range(3000):
        text = " ".join(rng.choice(words, rng.integers(1, 25)))
        want = plain_matches(model, text)
        assert [m for _, out in model.matches(text) for m in out] == want, text
        total = sum(model.weights[k] * x for k, x in want)
        assert abs(model.score(text) - 1 / (1 + np.exp(2.0 - 1.5 * np.log1p(total)))) < 1e-12


def test_toxicity_query(spark, tmp_path):
    rows = tox_rows(900) + [(900, None, 0), (901, "", 0), (902, "x" * 200_000, 0), (0, "once more of grumpfa", 1), (None, "grumpfel", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    df.drop("toxic").write.parquet(f"{tmp_path}/documents.parquet")
    df.filter("doc_id < 850 or doc_id >= 900").select("doc_id", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    from timberline.llm import queries

    got = queries.op4_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    truth = {i: y for i, _, y in rows}
    held = [r.predicted == truth[r.doc_id] for r in got if r.held_out]
    assert len(held) > 150 and np.mean(held) > 0.97
    known = {i for i in truth if i is not None and zlib.crc32(str(i).encode()) % 4 != 2 and (i < 850 or i >= 900)}
    model = toxicity.learn(df.filter(df.doc_id.isin(list(known))))
    for r in got:
        texts = [t for i, t, _ in rows if i == r.doc_id]
        scores = [1 / (1 + np.exp(-(model.bias + model.scale * np.log1p(sum(model.weights[k] * x for k, x in plain_matches(model, t or "")))))) for t in texts]
        assert any(abs(r.score - x) < 1e-9 for x in scores)


def test_fitting_lowers_the_loss_and_keeps_weights_positive():
    rng = np.random.default_rng(2)
    x = rng.random((200, len(toxicity.CELLS))) * (rng.random((200, len(toxicity.CELLS))) < 0.1) * 5
    y = (x[:, 3] + x[:, 5] > 0).astype(float)
    weights, bias, scale = toxicity.fitted(x, y, np.ones(200))
    loss = lambda w, b, s: np.mean(np.log1p(np.exp(-(2 * y - 1) * (b + s * np.log1p(x @ w)))))
    prior = np.array([toxicity.WEIGHTS[k] for k in toxicity.CELLS])
    assert min(weights.values()) > 0 and scale > 0 and loss(np.array([weights[k] for k in toxicity.CELLS]), bias, scale) < loss(prior, -3.0, 2.0)


@pytest.fixture(autouse=True)
def quiet():
    np.seterr(all="ignore")


@pytest.mark.parametrize("span", ["christopher_montgomery [at] mail [dot] records [dot] example [dot] institute [dot] uk", "christopher_montgomery [at] mail [dot] records [dot] example [dot] institute [dot] co [dot] uk"])
def test_long_spans_come_whole_wherever_they_lie(span):
    assert len(span) > 80
    texts = [("word and other things are in the text here " * 60)[: at - 1] + f" {span} " + "more words follow it now " * 30 for at in range(pii.STRIDE, 2 * pii.STRIDE + 60, 3)]
    for text, (_, spans) in zip(texts, pii.find(tagger.trained(), texts)):
        at = text.index(span)
        assert any((a, b) == (at, at + len(span)) for _, a, b in spans)


def test_samples_of_huge_tables_are_not_empty(spark):
    from timberline.llm import tables

    for total in (20_000, 2 * 10**10, 5 * 10**10, 10**15):
        share = (tables.hash_bound(12_000, total) + (1 << 63)) / (1 << 64)
        assert 0.99 < share * total / 12_000 < 1.01

    class Huge:
        """A table that says it has 5e10 rows."""

        columns = ["k"]

        def __init__(self, df):
            self.df = df

        def count(self):
            return 5 * 10**10

        def filter(self, condition):
            return self.df.filter(condition)

    rows = spark.range(400_000).withColumnRenamed("id", "k")
    assert 2_500 < tables.bounded_sample(Huge(rows), 10**10 * 5 // 100).count() < 5_500
    assert 800 < tables.bounded_sample(rows, 1_000).count() < 1_200
    # a row that makes up half the table is drawn once or not at all
    assert tables.bounded_sample(rows.union(spark.range(400_000).select((F.col("id") * 0).alias("k"))), 1_000).count() < 700


def test_tagger_by_stretches_equals_step_by_step():
    from timberline.llm import tagger

    model, rng = tagger.trained(), np.random.default_rng(4)
    x = rng.integers(32, 127, (70, 48)).astype(np.uint8)
    e = model.p["emb"][x]
    want = np.concatenate([model._forward(e, d, []) for d in "fb"], axis=2) @ model.p["out"] + model.p["bias"]
    em = model.emissions(x)
    assert em.shape == want.shape and np.abs(em - want).max() < 1e-3
    em = np.round(rng.standard_normal((40, 30, tagger.TAGS)) * 4).astype(np.float32)  # with ties
    for row, tags in zip(em, model.best_path(em)):
        score, back = model.p["first"] + row[0], []
        for s in row[1:]:
            all_ = score[:, None] + model.p["trans"]
            back.append(all_.argmax(axis=0))
            score = all_.max(axis=0) + s
        path = [int(score.argmax())]
        for b in back[::-1]:
            path.append(int(b[path[-1]]))
        assert tags.tolist() == path[::-1]
