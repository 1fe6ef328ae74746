import re
from collections import defaultdict

from tessera.llm import decontaminate as dc
from tessera.llm.queries import QUERIES

UNITS = "|".join(sorted(dc.UNITS, key=lambda u: (-len(u), u)))


def template(text):
    text = re.sub(r"(?<=[0-9])(?=[^\W\d_]|%)", " ", text or "")
    words = [w for w in re.sub(r"[^\w%.,]+|_|[.,](?![0-9])|(?<![0-9])[.,]", " ", text).split(" ") if w]
    out = []
    for w in words:
        if w[0].isupper():
            out.append("#p")
        elif re.fullmatch(r"[0-9][0-9.,]*", w):
            out.append("#n")
        elif out and out[-1] == "#n" and re.fullmatch(rf"(?:{UNITS}|%)", w):
            out.append("#u")
        else:
            out.append(w.lower())
    return words, out


def plain(docs, items):
    """Pairs and matched windows by comparing all windows, then the slots."""
    found = {}
    index = defaultdict(list)
    total = {}
    for i, t in items:
        w, k = template(t)
        size = min(dc.WINDOW, len(k))
        for p in range(len(k) - size + 1):
            win = k[p : p + size]
            if size >= dc.LITERALS and len({x for x in win if not x.startswith("#")}) >= dc.LITERALS:
                index[tuple(win)].append((i, p, w[p : p + size]))
                total[i] = total.get(i, 0) + 1
    for d, t in docs:
        w, k = template(t)
        diagonal = defaultdict(lambda: (set(), set()))
        for size in {len(x) for x in index}:
            for p in range(len(k) - size + 1):
                for i, q, bw in index.get(tuple(k[p : p + size]), ()):
                    places, pairs = diagonal[i, p - q]
                    places.add(q)
                    pairs.update((kk, b, x) for kk, b, x in zip(k[p : p + size], bw, w[p : p + size], strict=True) if kk.startswith("#"))
        for (i, _), (places, pairs) in diagonal.items():
            if len({(a, b) for a, b, _ in pairs}) == len(pairs) == len({(a, c) for a, _, c in pairs}):
                found[d, i] = max(found.get((d, i), 0), len(places))
    return {p: n for p, n in found.items() if n / total[p[1]] >= dc.COVERAGE}


def test_query_equals_plain(spark, small, texts):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]): r["n_windows"] for r in QUERIES["op4_decontamination"](spark, small).collect()}
    assert got == plain(texts, items)
    verbatim = {(d, i) for d, t in texts for i, s in items if s in t}
    assert verbatim <= set(got)


QUESTION = "If Anna buys 12 kg of apples and Anna gives 5 kg of them to her neighbour then how many apples does she keep for the winter"


def pairs(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string, doc_id int")
    return {(r["doc_id"], r["item_id"]): r for r in dc.contamination(d, b).collect()}


def test_changed_values(spark):
    other = QUESTION.replace("Anna", "Ben").replace("12", "7,5").replace("5 kg", "3 kg")
    clash = QUESTION.replace("Anna", "Ben", 1)
    docs = [(1, "Some words before. " + QUESTION, 0), (2, other + " and more words", 0), (3, "wholly other words in this text that share nothing", 0), (4, clash, 0), (5, None, 0), (None, QUESTION, 0), (6, "", 0), (1, "Some words before. " + QUESTION, 9)]
    got = pairs(spark, docs, [(1, QUESTION, 5), (2, None, 5), (3, "", 5), (None, QUESTION, 5), (1, QUESTION, 5)])
    assert set(got) == {(1, 1), (2, 1)}
    assert got[1, 1]["n_changed"] == 0 and got[1, 1]["coverage"] == 1.0
    assert got[2, 1]["n_changed"] > 0


def test_different_numbers_may_become_one(spark):
    item = "A robe takes 12 bolts of blue fiber and 6 bolts of white fiber so how many bolts make 3 robes in total"
    doc = "A robe takes 4 bolts of blue fiber and 2 bolts of white fiber so how many bolts make 2 robes in total"
    got = pairs(spark, [(1, doc, 0)], [(1, item, 0)])
    assert {(k, r["coverage"], r["n_slots"], r["n_changed"]) for k, r in got.items()} == {((1, 1), 1.0, 4, 3)}
    names = "Then Anna gives Ben a red apple and Ben gives Carl some of the green pears that he has"
    assert pairs(spark, [(1, names.replace("Carl", "Anna"), 0)], [(1, names, 0)]) == {}


CLIPS = "Natalia sold clips to 48 of her friends in April and then Natalia sold half as many clips in May so how many clips did Natalia sell altogether in both months"


def test_names_of_other_word_counts_and_other_case(spark):
    docs = [(1, CLIPS.replace("Natalia", "Mary Ann"), 0), (2, CLIPS.lower(), 0), (3, CLIPS.upper(), 0), (4, CLIPS.replace("Natalia", "Mary Ann", 1), 0), (5, CLIPS.lower().replace("48", "60").replace("natalia", "mary ann"), 0), (6, "Other words Of Another Kind Stand here And There", 0)]
    got = pairs(spark, docs, [(1, CLIPS, 0)])
    assert {(1, 1), (2, 1), (3, 1)} <= set(got) and (6, 1) not in got
    assert got[2, 1]["n_changed"] == got[3, 1]["n_changed"] == 0 and got[2, 1]["coverage"] == 1.0
    assert all(r["coverage"] <= 1.0 for r in got.values())


def test_items_of_few_literals(spark):
    items = ["Who wrote Romeo and Juliet?", "What is 17 * 23 + 5?", "Who is the CEO of Apple Inc?", "Was ist die Hauptstadt von Frankreich?", "How Many Days Are There In A Year Of Twelve Months"]
    docs = [(i, f"some words before {x} and after", 0) for i, x in enumerate(items)] + [(9, "What is 18 * 23 + 5?", 0), (10, "how many days are there in a year of twelve months", 0)]
    got = pairs(spark, docs, list((i, x, 0) for i, x in enumerate(items)))
    assert set(got) == {(i, i) for i in range(5)} | {(10, 4)}


def test_short_items_and_nothing(spark):
    got = pairs(spark, [(1, "well then some five word item here", 0)], [(1, "some five word item", 0)])
    assert set(got) == {(1, 1)}
    assert pairs(spark, [(1, "x", 0)], [(1, "too short", 0)]) == {}
    empty_docs = spark.createDataFrame([], "doc_id long, text string")
    empty_items = spark.createDataFrame([], "item_id long, text string")
    assert dc.contamination(empty_docs, empty_items).collect() == []


def test_plan_has_no_python(spark, small):
    plan = QUERIES["op4_decontamination"](spark, small)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_odd_rows(odd, empty, spark):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog again and again")], "item_id long, text string")
    assert {r["doc_id"] for r in dc.contamination(odd, items).collect()} == {0, 15}
    kept = dc.decontaminate(odd, items)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 3
    assert dc.decontaminate(empty, items).collect() == []


PROBLEMS = {
    "Natalia": "Natalia sold clips to 48 of her friends in April and then Natalia sold half as many clips in May so how many clips did Natalia sell altogether in both months",
    "Betty": "Betty is saving money for a new wallet which costs 100 dollars. Betty has only half of the money she needs. Her parents decided to give her 15 dollars and her grandparents twice as much. How much more money does Betty need to buy the wallet",
    "Julie": "Julie is reading a book of 120 pages. Yesterday Julie was able to read 12 pages and today she read twice as many pages as yesterday. If Julie wants to read half of the remaining pages tomorrow, how many pages should she read",
    "Mark": "Mark has a garden with flowers. Mark planted plants of three different colors in it. Ten of them are yellow and there are 80 percent more of those in purple. How many flowers does Mark have in the garden",
}
SPELLED = {"48": "forty-eight", "100": "one hundred", "15": "fifteen", "120": "one hundred twenty", "12": "twelve", "80": "eighty"}
KINDS = {
    "verbatim": lambda n, t: t,
    "numbers": lambda n, t: re.sub(r"\d+", lambda m: str(int(m[0]) * 3 + 1), t),
    "names of two words": lambda n, t: t.replace(n, "Anna Maria"),
    "lower case": lambda n, t: t.lower(),
    "lower case, other names": lambda n, t: t.replace(n, "sarah").lower(),
    "lower case, other names and numbers": lambda n, t: re.sub(r"\d+", lambda m: str(int(m[0]) + 7), t.replace(n, "omar")).lower(),
    "numbers as words": lambda n, t: re.sub(r"\d+", lambda m: SPELLED[m[0]], t),
    "other numbers as words, other names": lambda n, t: re.sub(r"\d+", "seventy-two", t.replace(n, "Peter"), count=1),
    "words as numbers": lambda n, t: t.replace("three", "3").replace("Ten", "10"),
}


def test_recall_by_kind(spark):
    docs, want = [], {}
    for k, change in KINDS.items():
        for i, (name, text) in enumerate(PROBLEMS.items()):
            want[len(docs)] = (k, i)
            docs.append((len(docs), f"Words that stand before it. {change(name, text)} And words that follow.", 0))
    docs.append((len(docs), " ".join(sorted(set(" ".join(PROBLEMS.values()).split()))), 0))  # the same words in another order
    got = set(pairs(spark, docs, [(i, t, 0) for i, t in enumerate(PROBLEMS.values())]))
    for k in KINDS:
        of = [(d, i) for d, (kind, i) in want.items() if kind == k]
        assert sum(p in got for p in of) >= 0.9 * len(of), k
    assert got <= {(d, i) for d, (_, i) in want.items()}


def test_items_without_anchors(spark):
    """One item of single literal words, one of no letters at all; the others keep to their suspects."""
    items = [(1, QUESTION, 0), (2, "if 3 plus 5 then 8 minus 2 gives 6 why 4", 0), (3, "17 * 23 + 5 = 396 - 8 / 4", 0)]
    docs = [(1, "first " + QUESTION, 0), (2, "now if 3 plus 5 then 8 minus 2 gives 6 why 4 then", 0), (3, "so 17 * 23 + 5 = 396 - 8 / 4 holds", 0), (4, "17 * 24 + 5 = 413", 0), (5, "if 9 plus 4 then 7 minus 1 gives 2 why 3", 0)]
    assert set(pairs(spark, docs, items)) == {(1, 1), (2, 2), (3, 3), (5, 2)}
    b = spark.createDataFrame(items, "item_id long, text string, doc_id int")
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    suspects, anywhere = dc._suspects(d, [*dc._strict_items(b, "item_id", "text").values(), dc._loose_items(b, "item_id", "text")[0]], "doc_id", "text")
    assert {r[0] for r in anywhere.collect()} == {3}
    assert 4 not in {r[0] for r in suspects.collect()}
