"""Toxicity: a weighted finite-state grammar over clauses.

Words become symbols: insult, threat, target, negation, report, quotation mark, copula
or determiner, intention, adversative, pause, other. Five transducers over symbol strings are
composed into one deterministic machine:

* insults: how an insult stands in its clause: called out (alone before a pause or an exclamation mark),
  predicated (after a copula or determiner), mentioned (after a preposition, a conjunction or another insult), or
  heading a phrase (before a copula, preposition or conjunction);
* threats: a threat is one after an intention or target, or before a target;
* targets: an insult near a person is addressed to that person;
* negation: what a negation reaches is negated, up to a pause or a "but";
* reported speech: what follows a verb of report, or stands in quotation marks, is reported.

What the machine puts out are matches of the grammar. An insult that nothing of the kind stands by is no
match, whatever its word: the context decides whether a word counts, and how much. A
match weighs its word's log-odds times the weight of its kind, and a
document's score is a logistic function of the logarithm of its summed weights.

The lexicon of insults (word beginnings that separate toxic from other
labelled documents) and all weights are fitted on a bounded sample. Closed
classes of words and rules of inflection for four languages are fixed.
"""

from __future__ import annotations

import functools
import re
from collections import Counter, defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.llm.tables import bounded_sample, slices
from timberline.session import materialize, release

#: At most about so many labelled documents are used to learn.
MAX_TRAIN_DOCS = 10_000
#: Word beginnings of these lengths are candidates, and whole words of any length.
STEM = (3, 10)
#: Least G statistic of a stem.
MIN_G = 26.0

INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, COPULA, INTENT, BUT, PAUSE, LINK, BANG, OTHER = "ITGNRQCFBPL!O"

# Closed classes of English, German, French and Spanish.
WORDS = {
    TARGET: """you your yours yourself yourselves he him his she her hers they them their theirs we us our everyone everybody someone anyone people
        du dich dir dein deine deinen deinem deiner ihr euch euer eure er ihn ihm sie ihnen ihre ihren alle jeder jemand leute
        tu toi te ton ta tes vous votre vos il elle lui ils elles eux leur leurs tous gens
        tú usted ustedes vosotros vosotras ti él ella ellos ellas vuestro vuestra todos todas gente""".split(),
    NEGATION: """not no never neither nor none nobody nothing hardly without isn't aren't wasn't weren't don't doesn't didn't won't can't cannot ain't shouldn't wouldn't
        nicht kein keine keinen keinem keiner nie niemals niemand nichts kaum ohne weder
        ne pas jamais aucun aucune rien personne sans ni guère nunca jamás ningún ninguna ninguno nadie nada tampoco sin""".split(),
    COPULA: """am is are was were be been being seem seems seemed look looks sound sounds such so very really total complete utter absolute
        bin bist ist sind seid war waren wart sein gewesen scheint so sehr wirklich total völlig ein eine einen einem einer der die das den dem
        suis es est sommes êtes sont était étaient être semble si très vraiment un une des le la les
        soy eres somos sois son era eran ser está están estás parece tan muy una unos unas el los las a an the this that these those""".split(),
    INTENT: """will shall going gonna want wants wanna should must would could deserve deserves hope wish let'll i'll we'll you'll he'll they'll
        werde wirst wird werden werdet will wollen soll sollte sollten muss müssen verdient hoffe
        vais vas va allons allez vont veux veut voulons devrait devraient doit mérite mérites espère
        voy vamos van quiero quiere queremos debe deberían merece mereces ojalá espero""".split(),
    LINK: """of in to by as with for and or on at from into like than about against between after before over under through
        von mit und oder zu zum zur auf für als wie bei aus nach über unter durch gegen im am vom
        de du des en à au aux pour avec et ou par sur dans comme chez contre
        del al con y e o por para en como sobre entre contra desde hasta""".split(),
    BUT: "but however although though yet sondern aber doch jedoch obwohl mais cependant pourtant quoique pero sino aunque mas".split(),
}
# Beginnings of verbs, with the endings that their language's inflection may add.
_VERBS = {
    THREAT: [
        ("kill hurt destroy beat punish threaten murder stab shoot strangle crush smash attack burn hang drown poison slaughter torture", "|s|es|ed|t|ing|er"),
        ("töt verletz zerstör schlag bestraf bedroh ermord erschieß erwürg verbrenn verprügel vergift folter vernicht", "e|st|t|en|te|ten|et|end"),
        ("tu bless détrui frapp pun menac assassin poignard étrangl écras brûl empoisonn tortur massacr", "e|es|ons|ez|ent|er|é|ée|re|s|t|ir|is"),
        ("mat her destru golpe castig amenaz asesin apuñal estrangul aplast quem envenen tortur", "o|as|a|amos|an|ar|é|ó|ado|ada|ir|ido|iré|aré|ando"),
    ],
    REPORT: [
        ("say said says tell told claim report write wrote written quote state argue explain recall repeat shout whisper allege", "|s|d|ed|ing|ting"),
        ("sag schrieb erklär bericht behaupt zitier erzähl mein rief antwort", "e|st|t|en|te|ten|ete|eten"),
        ("di disait écri déclar affirm racont cit rapport répét cri", "t|s|re|e|er|ent|ait|a|é|vit|vait|sent"),
        ("dij dic dec escrib declar afirm cont cit repit grit", "o|e|a|es|en|an|ía|ió|ó|ieron|ir|aron|aba"),
    ],
}
# Fixed values end here.

_STRONG = re.compile(r"[.!?;\n]+")
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”«»„]|[,:]")


def _verb(symbol: str) -> str:
    return "|".join(f"(?:{'|'.join(stems.split())})(?:{endings})" for stems, endings in _VERBS[symbol])


_VERB = {s: re.compile(_verb(s)) for s in _VERBS}


@functools.lru_cache(1 << 16)
def closed_class(token: str) -> str:
    """The symbol of a token that is no insult."""
    if len(token) == 1 and not token.isalpha():
        return PAUSE if token in ",:" else QUOTE
    for symbol, words in _SETS.items():
        if token in words:
            return symbol
    return next((s for s, r in _VERB.items() if r.fullmatch(token)), OTHER)


_SETS = {s: frozenset(w) for s, w in WORDS.items()}


class Transducer:
    """Deterministic: a step from a state with a symbol gives an output symbol and the next state. Steps are remembered."""

    def __init__(self, start, step: Callable):
        self.start, self._step, self._known = start, step, {}

    def step(self, state, symbol: str) -> tuple:
        known = self._known.get((state, symbol))
        if known is None:
            known = self._known[state, symbol] = self._step(state, symbol)
        return known

    def compose(self, other: Transducer) -> Transducer:
        """Read with ``self`` and feed its output to ``other``; states are made as they are reached."""

        def both(state, symbol):
            middle, a = self.step(state[0], symbol)
            out, b = other.step(state[1], middle)
            return out, (a, b)

        return Transducer((self.start, other.start), both)

    def run(self, symbols) -> list[str]:
        state, out = self.start, []
        for s in symbols:
            o, state = self.step(state, s)
            out.append(o)
        return out


#: Reach, in symbols, of what comes before and after.
BEFORE, AFTER, NEGATED = 5, 3, 4
#: Words that a copula, determiner, preposition or conjunction reaches.
GOVERNS = 6
CALLED, MENTIONED, PREDICATED, ADDRESSED, POINTED, THREATENED, HEADED = KINDS = "xmpdath"


def _insults() -> Transducer:
    """State: what stands before (the clause's start, a copula, a link, an insult at the start, nothing), how many words it still reaches,
    and how many words an insult that nothing governs still waits for what it heads."""

    def step(state, s):
        before, reach, waits = state
        if s == INSULT:
            out = {COPULA: PREDICATED, LINK: MENTIONED, CALLED: MENTIONED}.get(before, s)
            return out, (CALLED if before == PAUSE else LINK, GOVERNS, GOVERNS if out == s else 0)
        if s in (PAUSE, BANG):
            return CALLED if before == CALLED else s, (PAUSE, 0, 0)
        if s == QUOTE:
            return s, (PAUSE, 0, 0)
        if s in (COPULA, LINK):
            return HEADED if waits else s, (s, GOVERNS, 0)
        return s, (*((before, reach - 1) if before in (COPULA, LINK) and reach > 1 else (OTHER, 0)), max(waits - 1, 0))

    return Transducer((PAUSE, 0, 0), step)


def _threats() -> Transducer:
    """State: symbols since an intention or target, and since a threat that waits for its target."""

    def step(state, s):
        near, waits = state
        if s == THREAT:
            return (THREATENED, (max(near - 1, 0), 0)) if near else (OTHER, (0, AFTER))
        if s == TARGET and waits:
            return THREATENED, (BEFORE, 0)
        return s, (BEFORE if s in (INTENT, TARGET) else 0 if s in (BUT, REPORT) else max(near - 1, 0), max(waits - 1, 0))

    return Transducer((0, 0), step)


def _targets() -> Transducer:
    """Insults after a target are addressed, unless the target is who reports; a target soon after an insult points at it.

    State: symbols since a target and since an insult that waits for one, and whether the insult before was addressed, which a call or a phrase does not count again.
    """

    def step(state, s):
        near, waits, taken = state
        if s in (INSULT, MENTIONED, PREDICATED):
            return (ADDRESSED, (max(near - 1, 0), 0, True)) if near else (s, (0, AFTER, False))
        if s in (CALLED, HEADED):
            return (PAUSE if s == CALLED else OTHER) if taken else s, (max(near - 1, 0), max(waits - 1, 0), False)
        if s == TARGET:
            return (POINTED if waits else s), (BEFORE, 0, taken)
        return s, (0 if s == REPORT else max(near - 1, 0), max(waits - 1, 0), taken)

    return Transducer((0, 0, False), step)


def _negation() -> Transducer:
    def step(left, s):
        if s[0] in KINDS:
            return s + "-" if left else s, 0 if s == CALLED else max(left - 1, 0)
        return s, NEGATED if s == NEGATION else 0 if s in (BUT, PAUSE) else max(left - 1, 0)

    return Transducer(0, step)


def _reports() -> Transducer:
    """State: whether a verb of report has come, whether a quotation is open."""

    def step(state, s):
        told, quoted = state
        if s[0] in KINDS:
            return s + "'" if told or quoted else s, state
        return s, (told or s == REPORT, quoted ^ (s == QUOTE))

    return Transducer((False, False), step)


GRAMMAR = _insults().compose(_threats()).compose(_targets()).compose(_negation()).compose(_reports())
#: Log-odds that stand for a threat.
THREAT_ODDS = 3.0
#: Where fitting starts, and what it is drawn to: weights of the kinds, factors of negation and report.
PRIOR = {CALLED: 1.0, MENTIONED: 0.6, PREDICATED: 1.0, HEADED: 0.6, ADDRESSED: 1.5, POINTED: 0.5, THREATENED: 1.5}
NEGATED_FACTOR, REPORTED_FACTOR = 0.4, 0.6
WEIGHTS = {k + n + r: w * (NEGATED_FACTOR if n else 1.0) * (REPORTED_FACTOR if r else 1.0) for k, w in PRIOR.items() for n in ("", "-") for r in ("", "'")}
CELLS = sorted(WEIGHTS)


def _either(words: list[str]) -> str:
    """A regular expression for any of the words, shared beginnings first."""
    if "" in words:
        return ""
    by: dict[str, list[str]] = defaultdict(list)
    for w in words:
        by[w[0]].append(w[1:])
    return "(?:" + "|".join(re.escape(c) + _either(rest) for c, rest in sorted(by.items())) + ")"


@dataclass
class ToxicityModel:
    """Stems with log-odds, weights of the grammar's matches, and the logistic from their sum to a score."""

    stems: dict[str, float] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    bias: float = -3.0
    scale: float = 2.0

    def __post_init__(self):
        threat = f"(?:{_verb(THREAT)})(?![^\\W\\d_])"
        self._hit = re.compile(rf"(?<![^\W\d_])(?:{threat}{'|' + _either(sorted(self.stems)) if self.stems else ''})")
        self._long = max(map(len, self.stems), default=0)

    def __reduce__(self):
        return (ToxicityModel, (self.stems, self.weights, self.bias, self.scale))

    def symbol(self, word: str) -> tuple[str, float]:
        for n in range(min(len(word), self._long), 0, -1):
            w = self.stems.get(word[:n])
            if w is not None:
                return INSULT, w
        kind = closed_class(word)
        return kind, THREAT_ODDS if kind == THREAT else 0.0

    def matches(self, text: str) -> list[tuple[str, list[tuple[str, float]]]]:
        """Clauses with what the grammar finds in them: kinds of match and log-odds of the words that make them."""
        low = text.lower()
        if not self._hit.search(low):
            return []
        found, end = [], 0
        cuts = [m.span() for m in _STRONG.finditer(low)] + [(len(low), len(low))]
        for a, b in cuts:
            clause = low[end:a]
            end = b
            if not clause or not self._hit.search(clause):
                continue
            state, odds, out = GRAMMAR.start, 0.0, []
            for token in _TOKEN.findall(clause):
                symbol, lex = self.symbol(token)
                kind, state = GRAMMAR.step(state, symbol)
                odds = lex or odds  # a match that a target completes is that of the word before
                if kind[0] in KINDS:
                    out.append((kind, odds))
            if "!" in low[a:b]:
                kind, state = GRAMMAR.step(state, BANG)
                if kind[0] in KINDS:
                    out.append((kind, odds))
            if out:
                found.append((clause.strip(), out))
        return found

    def clauses(self, text: str) -> list[tuple[str, float]]:
        """Matched clauses with their weights, in order."""
        return [(c, sum(self.weights[k] * x for k, x in out)) for c, out in self.matches(text)]

    def evidence(self, text: str) -> np.ndarray:
        """Summed log-odds by kind of match."""
        x = np.zeros(len(CELLS))
        for _, out in self.matches(text):
            for k, odds in out:
                x[_CELL[k]] += odds
        return x

    def score(self, text: str | None) -> float:
        total = sum(w for _, w in self.clauses(text or ""))
        return float(1 / (1 + np.exp(-(self.bias + self.scale * np.log1p(total)))))


_CELL = {k: i for i, k in enumerate(CELLS)}


def _features(text: str) -> set[str]:
    words = {w for w in _TOKEN.findall(text.lower()) if w[0].isalpha()}
    return {w[:n] for w in words for n in range(STEM[0], min(len(w), STEM[1]) + 1)} | {w for w in words if len(w) > STEM[1]}


def _sketch(text: str) -> int:
    """Least hash of a pair of neighbouring words; near copies mostly agree on it."""
    words = text.lower().split()
    return min((xxhash.xxh3_64_intdigest(f"{a} {b}") >> 1 for a, b in zip(words, words[1:])), default=xxhash.xxh3_64_intdigest(text) >> 1)


def _g(a: Column, b: Column, pos: int, neg: int) -> Column:
    """G statistic of a feature seen in ``a`` of ``pos`` and ``b`` of ``neg`` documents."""
    share = (a + b) / (pos + neg)

    def term(x, e):
        return F.when(x > 0, x * F.log(x / e)).otherwise(0.0)

    return 2 * (term(a, pos * share) + term(b, neg * share) + term(pos - a, pos * (1 - share)) + term(neg - b, neg * (1 - share)))


def learn(docs: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id",
          max_docs: int = MAX_TRAIN_DOCS) -> ToxicityModel:
    """Lexicon, weights and logistic from at most about ``max_docs`` labelled rows.

    Tasks count, per word beginning, the toxic and other documents that have
    it; sums by key and their G statistic follow, and what leans to the toxic
    ones significantly comes to the driver: parts of a bounded sample. Of near
    copies one is counted. Of beginnings that extend each other the most
    telling is kept. No usable labels: no stems, low scores.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"), F.col(label_col).cast("int").alias("y"))
    rows = bounded_sample(rows.filter("t is not null and y in (0, 1)"), max_docs).repartition(8)

    def sketch(batches):
        for batch in batches:
            for piece, texts in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array([_sketch(t) for t in texts], pa.int64())], names=["i", "t", "y", "s"])

    # near copies share their rare words, which would pass for telling ones
    sketched = rows.mapInArrow(sketch, "i long, t string, y int, s long")
    rows = materialize(sketched.groupBy("s", "y").agg(F.min("i").alias("i"), F.min_by("t", "i").alias("t")).select("i", "t", "y"))

    def count(batches):
        held: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for batch in batches:
            for piece, texts in slices(batch, 1):
                for text, y in zip(texts, piece.column(2).to_pylist()):
                    for f in _features(text):
                        held[f][y] += 1
        keys, values = list(held), list(held.values())
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array([v[1] for v in values], pa.int64()), pa.array([v[0] for v in values], pa.int64())],
            names=["f", "a", "b"],
        )

    counted = rows.mapInArrow(count, "f string, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    size = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    pos, neg = size.get(1, 0), size.get(0, 0)
    if not pos or not neg:
        release(rows)
        return ToxicityModel()
    leans = counted.filter((F.col("a") >= 3) & (F.col("a") * neg > 3 * F.col("b") * pos)).withColumn("g", _g(F.col("a"), F.col("b"), pos, neg))
    some = leans.filter(F.col("g") >= MIN_G).collect()
    stems: dict[str, float] = {}
    begun: Counter = Counter()
    for r in sorted(some, key=lambda r: (-r["g"], -len(r["f"]), r["f"])):
        f, a, b = r["f"], r["a"], r["b"]
        if begun[f] or any(f[:n] in stems for n in range(1, len(f))):
            continue
        stems[f] = float(np.log((a + 0.5) / (pos + 1)) - np.log((b + 0.5) / (neg + 1)))
        begun.update(f[:n] for n in range(1, len(f) + 1))
    model = ToxicityModel(stems)

    def evidence(batches):
        for batch in batches:
            for piece, texts in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([pa.array([model.evidence(t).tolist() for t in texts], pa.list_(pa.float64())), piece.column(2)], names=["x", "y"])

    # documents with equal evidence are one row with a count
    seen = rows.mapInArrow(evidence, "x array<double>, y int").groupBy("x", "y").count().orderBy("x", "y").collect()
    release(rows)
    return ToxicityModel(stems, *fitted(np.array([r["x"] for r in seen]), np.array([r["y"] for r in seen], float), np.array([r["count"] for r in seen], float)))


def fitted(x: np.ndarray, y: np.ndarray, n: np.ndarray, steps: int = 400) -> tuple[dict[str, float], float, float]:
    """Weights of the kinds, bias and scale: most likely on rows of evidence with labels and counts, drawn to the prior."""
    start = np.concatenate([np.log([WEIGHTS[k] for k in CELLS]), [-3.0, np.log(2.0)]])
    theta, m, v = start.copy(), np.zeros(len(start)), np.zeros(len(start))
    for step in range(1, steps + 1):
        w, bias, scale = np.exp(theta[:-2]), theta[-2], np.exp(theta[-1])
        total = x @ w
        low = np.log1p(total)
        d = n * (1 / (1 + np.exp(-np.clip(bias + scale * low, -30, 30))) - y)
        g = np.concatenate([(d * scale / (1 + total)) @ x * w, [d.sum(), (d * low).sum() * scale]]) + 0.5 * (theta - start)
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        theta = theta - 0.05 * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return dict(zip(CELLS, np.exp(theta[:-2]).tolist())), float(theta[-2]), float(np.exp(theta[-1]))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_out: str = "score",
                   clauses_out: str | None = None) -> DataFrame:
    """Append a score from 0 to 1 to every row, and the matched clauses with weights if wanted.

    Whole texts are read. Null and empty texts get the score of a text
    without matches; more matched clauses always score higher. Input columns named like an output are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    drop = [c for c in (score_out, clauses_out) if c and c != text_col]
    kept = docs.drop(*drop)
    names, at = kept.columns, kept.columns.index(text_col)
    clause = T.ArrayType(T.StructType([T.StructField("clause", T.StringType()), T.StructField("weight", T.DoubleType())]))
    more = [T.StructField(score_out, T.DoubleType())] + ([T.StructField(clauses_out, clause)] if clauses_out else [])
    arrow = pa.list_(pa.struct([("clause", pa.string()), ("weight", pa.float64())]))

    def run(batches):
        for batch in batches:
            for piece, texts in slices(batch, at):
                columns = [*piece.columns, pa.array([shared.value.score(t) for t in texts], pa.float64())]
                if clauses_out:
                    columns.append(pa.array([shared.value.clauses(t or "") for t in texts], arrow))
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *(f.name for f in more)])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *more]))
