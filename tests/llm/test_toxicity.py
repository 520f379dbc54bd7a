import math
import random
import re
import zlib

from tests.llm import cases
from tidewell.llm import toxicity

LABELS = "doc_id long, quality int, toxic int"


def slow_score(grammar, text):
    """The score from window definitions: no automaton, no transducer."""
    text = (text or "").lower()
    sums = []
    for piece in re.split(r"[.!?;\n]", text):
        words = re.findall(r"\w+", piece)
        symbols, k = [], 0
        while k < len(words):
            pair = tuple(words[k : k + 2])
            if pair in grammar.pairs:
                symbols.append(grammar.pairs[pair])
                k += 2
                continue
            starts = [b for b in grammar.beginnings if words[k].startswith(b)]
            symbols.append(grammar.words.get(words[k]) or (("insult", grammar.beginnings[max(starts, key=len)]) if starts else ("", 0.0)))
            k += 1
        kinds = [s for s, _ in symbols]
        total = 0.0
        for k, (kind, weight) in enumerate(symbols):
            if kind not in ("insult", "threat"):
                continue
            before, after = (lambda n: kinds[max(0, k - n) : k]), (lambda n: kinds[k + 1 : k + 1 + n])
            aimed, meant = "target" in before(4) + after(4), "intent" in before(3)
            f = grammar.factors
            weight *= f["negated"] if "negation" in before(3) else 1
            weight *= f["reported"] if "report" in before(8) + after(8) else 1
            weight *= (f["aimed"] if aimed else 1) * (f["meant"] if meant else 1)
            total += weight * (f["bare"] if kind == "threat" and not aimed and not meant else 1)
        sums.append(total)
    worst = max([0.0, *sums])
    a, b, c = grammar.calibration
    return 1 / (1 + math.exp(-(a + b * math.log1p(worst) + c * math.log1p(sum(sums) - worst))))


def talk(n, seed):
    """Random sentences over the grammar's own words."""
    r = random.Random(seed)
    words = [*toxicity.INSULT[:5], *toxicity.THREAT, *toxicity.TARGET[:6], *toxicity.NEGATION[:4], *toxicity.REPORT[:6], *toxicity.INTENT, "zarkolin", "x", "sky", "the", "to", "up", "beat"]
    return [" ".join(r.choice(words) + r.choice(["", "", "", ",", ".", "!", "\n"]) for _ in range(r.randrange(40))) for _ in range(n)]


def test_scores_are_those_of_the_definition():
    g = toxicity.Grammar([("zarko", True, 3.0), ("dumb", False, 5.0), ("the sky", False, 1.5)], (-3.0, 2.0, 0.5), {"negated": 0.3, "reported": 0.6, "aimed": 1.7, "meant": 2.5})
    for text in talk(600, 4) + ["", None, "kill", cases.LONG + " you idiot"]:
        assert abs(g.score_text(text) - slow_score(g, text)) < 1e-12, text


def test_composition_is_the_product():
    parts = [toxicity.scope("negation", "negated"), toxicity.scope("target", "aimed"), toxicity.scope("report", "reported")]
    whole = toxicity.compose(*parts)
    r = random.Random(2)
    for _ in range(50):
        states, state = [p.start for p in parts], whole.start
        for _ in range(12):
            symbol = r.choice([*toxicity.SYMBOLS, ""])
            steps = [p.step(s, symbol) for p, s in zip(parts, states)]
            states = [s for s, _ in steps]
            state, marks = whole.step(state, symbol)
            assert marks == steps[0][1] | steps[1][1] | steps[2][1]


def test_clauses_count_not_isolated_words():
    g = toxicity.Grammar()

    def weight(text):
        return g.weigh(g.clauses(text))[0]

    assert weight("i will kill you") > weight("you kill") > weight("kill") and weight("kill the process") == weight("kill")
    assert weight("what an idiot you are") > weight("what an idiot") > weight("this is not an idiot")
    assert weight("what an idiot") > weight("somebody said idiot") and weight("idiot, he said") < weight("idiot, he thought")
    assert weight("you pathetic worthless clown walk on") > weight("pathetic weather. worthless paper. clown fish")
    assert g.score_text("i will kill you") > g.score_text("kill")
    assert weight("nothing of the kind") == 0 and weight("according to them") == 0


def labelled(n=600):
    texts, labels = cases.filler(n, 8, 30), []
    for k in range(n):
        toxic = k % 5 == 0
        if toxic:
            words = texts[k].split()
            words.insert(7, random.Random(k).choice(["zarkole", "zarkoli", "zarkota", "grimbaz"]))
            texts[k] = " ".join(words)
        labels.append((k, 1, int(toxic)))
    return [(k, t, "en", "a", 1) for k, t in enumerate(texts)], labels


def contextual(n=1500):
    """The same words in toxic and in clean rows: only what stands around them tells."""
    texts, labels = cases.filler(n, 28, 24), []
    r = random.Random(7)
    insult = lambda: r.choice(toxicity.INSULT[:12])
    threat = lambda: r.choice(toxicity.THREAT[:6])
    toxic = [lambda: f"you {insult()}", lambda: f"such {insult()} you are", lambda: f"i will {threat()} you", lambda: f"we {threat()} them"]
    clean = [lambda: f"not {insult()}", lambda: f"never {insult()} here", lambda: f"somebody reported {insult()}", lambda: f"{threat()} process", lambda: f"quoted {insult()} again"]
    for k in range(n):
        kind = k % 3
        if kind < 2:
            words = texts[k].split()
            words[9:9] = r.choice(clean if kind else toxic)().split()
            texts[k] = " ".join(words)
        labels.append((k, 1, int(kind == 0)))
    return [(k, t, "en", "a", 1) for k, t in enumerate(texts)], labels


def held_out(got, labels):
    truth = {k: t for k, _, t in labels}
    held = [r for r in got if r["held_out"]]
    assert held and all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in held)
    return sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held)


def test_without_scopes_held_out_verdicts_are_worse(spark):
    rows, labels = contextual()
    docs, marks = cases.docs(spark, rows), spark.createDataFrame(labels, LABELS)
    whole, bare = toxicity.learn(docs, marks), toxicity.learn(docs, marks, scoped=False)
    assert whole.factors["negated"] < toxicity.FACTORS["negated"] and whole.factors["reported"] < toxicity.FACTORS["reported"]
    with_scopes, without = (held_out(toxicity.scored(docs, marks, g).collect(), labels) for g in (whole, bare))
    assert with_scopes >= 0.95 and without <= with_scopes - 0.15


def test_learns_words_and_beginnings_and_holds_out(spark):
    rows, labels = labelled()
    docs, marks = cases.docs(spark, rows + [r for r in cases.ROWS if r[0] is None]), spark.createDataFrame(labels, LABELS)
    got = toxicity.scored(docs, marks).collect()
    assert len(got) == len(rows) + 2 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["held_out"] for r in got if r["doc_id"] is None} == {False}
    assert held_out(got, labels) >= 0.98
    kept = toxicity.keep_clean(docs, marks)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {r["doc_id"] for r in got if not r["predicted"]}


def test_learns_pairs_and_weights_of_seeds(spark):
    filler = cases.filler(900, 5, 12)
    texts = [(f"{t} fetch bone {t.split()[0]}" if k % 3 == 0 else f"{t} {'fetch' if k % 2 else 'bone'} clown", int(k % 3 == 0)) for k, t in enumerate(filler)]
    learned = {t: w for t, b, w in toxicity.learned_patterns(spark.createDataFrame(texts, "text string, toxic int"))}
    assert learned["fetch bone"] > 3 and "fetch" not in learned
    assert learned["clown"] < toxicity.SEED_INSULT / 2  # common in clean rows


def test_partitions_without_rows(spark):
    sample = spark.createDataFrame([("an idiot", 1)] * 30 + [("a day", 0)] * 300, "text string, toxic int").repartition(340)
    assert [p[:2] for p in toxicity.learned_patterns(sample)]


def test_copies_of_a_toxic_text_teach_no_more_than_the_text():
    rows = [[0, 1, 2]] * 30 + [[0]] * 20
    assert toxicity.explaining(rows, [0.9, 0.95, 0.95], [5, 6, 7]) == [0]


def test_edge_cases(spark):
    none = spark.createDataFrame([], LABELS)
    got = toxicity.scored(cases.docs(spark), none).collect()
    assert len(got) == len(cases.ROWS) and all(r["predicted"] == 0 for r in got)
    assert toxicity.scored(cases.docs(spark, []), none).count() == 0
    odd = spark.createDataFrame([(1, None, None), (1, 1, 1), (1, 1, 0), (None, 1, 1), (2, 1, 1)], LABELS)
    got = toxicity.scored(cases.docs(spark), odd).collect()
    assert len(got) == len(cases.ROWS) and all(r["held_out"] is not None for r in got)
