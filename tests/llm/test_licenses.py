import random
import re

from chatterflow.llm import licenses as L
from chatterflow.llm import queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def base(text):
    w, found = words(text), []
    for label, phrases in L.PHRASES.items():
        for p in phrases:
            p = p.split()
            found += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), sorted(found)


def test_statistics_equal_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        templates = {str(i): tuple(" ".join(rng.choices("abcd", k=rng.randint(1, 12))) for _ in range(2)) for i in range(3)}
        a = L.automaton(templates, {"p": ("a b", "b", "a b b a")})
        assert len(a.next) <= 2 * sum(a.lengths) + 1
        strings = [t.split() for own in templates.values() for t in own] + [["a", "b"], ["b"], ["a", "b", "b", "a"]]
        inside = {tuple(s[i:j]) for s in strings for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        text = rng.choices("abcd", k=40)
        for i, (state, n) in enumerate(L.statistics(a, [a.vocabulary.get(w, -1) for w in text])):
            assert n == max((k for k in range(i + 2) if tuple(text[i + 1 - k : i + 1]) in inside), default=0)
            ends = {(t, y) for t, s in enumerate(strings[:-3], 3) for y in range(n, len(s) + 1) if s[y - n : y] == text[i + 1 - n : i + 1]}
            assert not n or set(a.spots[state]) == ends


def test_places_equal_brute_force(spark, docs):
    rng = random.Random(2)
    vocabulary = "gnu general public license apache cc by mit License MIT the GNU Licensé x1 été 4".split()
    joins = [" ", "\n", " - ", ", ", " ", ".", "_"]
    texts = ["".join(w + rng.choice(joins) for w in rng.choices(vocabulary, k=rng.randint(0, 80))) for _ in range(400)]
    texts += [None, "", "CC BY", "cc-by", "ccby", "MIT\x00LICENSE", "mit license" * 3, "gnu general public license " * 20_000, "é" * 5, "Apache LICENSE"]
    got = {r.doc_id: r for r in L.scan(docs(texts)).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_words, [(p.start, p.label) for p in got[i].places]) == base(t), t
    single = L.scan(docs(["mit x mit", "x"]), {}, {"m": ("mit",)}).collect()
    assert [[p.start for p in r.places] for r in single] == [[0, 2], []]


def test_spans_of_templates(docs):
    mit, gpl = L.TEMPLATES["mit"][0], L.TEMPLATES["gpl"][1]
    filler = "la maison est grande und das wetter war schön " * 40
    edited = mit.replace("without restriction", "WITHOUT any kind of restriction").replace("furnished to do so", "furnished so").upper()
    half = " ".join(mit.split()[:60])
    shuffled = " ".join(random.Random(3).sample(mit.split(), len(mit.split())))
    texts = [filler + mit + " " + filler, filler + edited + " " + gpl, half, shuffled, filler, None, "", (mit + " ") * 30, "Licensed under CC BY-NC 4.0."]
    got = {r.doc_id: r for r in L.scan(docs(texts)).collect()}
    n = len(words(filler))
    (span,) = got[0].spans
    assert (span.label, span.start, span.end, span.covered, span.share) == ("mit", n, n + len(mit.split()), len(mit.split()), 1.0)
    assert {s.label for s in got[1].spans} == {"mit", "gpl"} and all(s.share > 0.9 for s in got[1].spans)
    for i in (2, 3, 4, 5, 6):
        assert got[i].spans == [] and got[i].score == 0.0
    assert len([s for s in got[7].spans if s.label == "mit"]) == 30
    assert {s.label for s in got[8].spans} == {"cc-by-nc"} and got[8].score == 1.0
    assert L.scan(docs([])).collect() == []


def best_chain(matches, max_gap):
    """Covered words of the best chain, over all chains."""
    best = 0

    def extend(last, covered, i):
        nonlocal best
        best = max(best, covered)
        for j in range(i, len(matches)):
            x, y, n = matches[j]
            new = n if last is None else min(n, x - last[0], y - last[1])
            if last is None or (new > 0 and x > last[0] and x - n - last[0] <= max_gap):
                extend((x, y), covered + new, j + 1)

    extend(None, 0, 0)
    return best


def test_chains_equal_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        matches = sorted((rng.randint(4, 40), rng.randint(4, 30), rng.randint(1, 4)) for _ in range(rng.randint(1, 8)))
        got = L.chains(matches, 30, 1, 6, 0.0)
        assert max(c for _, _, c in got) == best_chain(matches, 6)
        assert all(a[1] <= b[0] for a, b in zip(got, got[1:]))


def test_query_digests(spark, odd):
    out = queries.op12_license_scan(spark, "/root/testdata/sf0.01")
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    hits = 0
    for r in out.collect():
        n, found = base(texts[r.doc_id])
        starts = [i for i, _ in found]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(found), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in found})) and 0 <= r.score <= 1
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and r.labels == ",".join(sorted(set(r.labels.split(","))))
        hits += bool(found)
    assert hits > 5 and L.scan(odd).count() == 14
