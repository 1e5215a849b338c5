import random
import re

from aularank.llm import op3_licences as L

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def naive(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    places = [(i, label) for phrase, label in L.PHRASES for i in range(len(words)) if words[i: i + len(phrase.split())] == phrase.split()]
    return words, sorted(places)


def test_phrase_places_and_matches():
    rng = random.Random(1)
    a = L.Automaton(L.PHRASES, L.TEMPLATES)
    vocabulary = ["mit", "license", "apache", "general", "public", "gnu", "the", "é", "licensed", "under"]
    runs = [[a_w for a_w in L.words_of(t.encode())] for _, t in L.TEMPLATES]
    for _ in range(300):
        text = " ".join(rng.choice(vocabulary) if rng.random() < 0.8 else b" ".join(rng.choice(runs)[: rng.randint(1, 30)]).decode() for _ in range(rng.randint(0, 40)))
        words, places = naive(text)
        f = L.scan(text.encode(), a, L.LicenceParams())
        assert f.n_words == len(words) and sorted(f.places) == places
        for t, cover in f.cover.items():  # a cover needs a long run of the template in the text
            run = [w.decode() for w in runs[t]]
            assert 0 < cover <= 1
            assert any(words[i: i + 4] == run[j: j + 4] for i in range(len(words)) for j in range(len(run) - 3))


def test_every_template_is_found():
    a = L.Automaton(L.PHRASES, L.TEMPLATES)
    for t, (label, text) in enumerate(L.TEMPLATES):
        words = ("zz " + text + " zz").split()
        assert L.scan(" ".join(words).encode(), a, L.LicenceParams()).cover[t] == 1.0
        if len(words) > 40:  # two words replaced: two long matches, chained
            words[20:21] = ["other"]
            assert L.scan(" ".join(words).encode(), a, L.LicenceParams()).cover[t] > 0.9


def test_spans_tell_where_a_licence_stands(spark, docs_of):
    cc = "Licensed under CC BY-NC 4.0"
    rows = [(1, "zz " * 5 + cc + " zz" * 30 + " " + cc + " " + cc), (2, None), (3, "zz")]
    got = {r["doc_id"]: r["spans"] for r in L.license_scan(docs_of(rows)).collect()}
    t, size = len(L.TEMPLATES) - 1, len(L.words_of(cc.encode()))
    want = [("cc-nc", t, at, at + size - 1, 0, size - 1, 1.0) for at in (5, 35 + size, 35 + 2 * size)]
    assert [tuple(x) for x in got[1]] == want and got[2] == got[3] == []


def test_chain_goes_on_at_the_second_place_of_repeated_words():
    a = L.Automaton(L.PHRASES, L.TEMPLATES)
    t = next(i for i, (label, _) in enumerate(L.TEMPLATES) if label == "bsd")
    text = L.TEMPLATES[t][1].replace("must reproduce the above", "must replicate the above").replace("disclaimer in the documentation", "disclaimer inside the documentation")
    n = len(L.words_of(text.encode()))
    f = L.scan(text.encode(), a, L.LicenceParams())
    assert f.cover[t] == (n - 2) / n
    # a match that lies behind does not end the chain
    words = L.TEMPLATES[t][1].split()
    stray = " ".join(words[:40] + ["zz"] + words[:5] + ["zz"] + words[40:])
    assert L.scan(stray.encode(), a, L.LicenceParams()).cover[t] == 1.0


def test_rows(spark, docs_of):
    long = "word " * 200_000 + "MIT-License."
    rows = [(1, "Released under the MIT License. mit\nlicense"), (2, None), (3, ""), (4, long), (4, long), (None, "Licensed under CC BY-NC 4.0")]
    got = sorted(L.license_scan(docs_of(rows)).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    assert (got[0]["n_base"], got[0]["first_word"], got[0]["last_word"], got[0]["base_labels"], got[0]["labels"], got[0]["score"]) == (2, 3, 5, "mit", "mit", 1.0)
    for r in got[1:3]:
        assert (r["n_words"], r["n_base"], r["first_word"], r["labels"], r["score"]) == (0, 0, None, "", 0.0)
    assert got[3]["first_word"] == 200_000 and got[3] == got[4]
    assert got[5]["base_labels"] == "" and got[5]["labels"] == "cc-nc"
    assert L.license_scan(docs_of(rows).limit(0)).count() == 0
