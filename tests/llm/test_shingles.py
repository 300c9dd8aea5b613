import random

from tapeline.llm import shingles


def test_sets_follow_words():
    r = random.Random(1)
    texts = [None, "", " \n\t", "a", "A", "a b", "b a", "É b c", "é b c", "x" * 1500000, "x" * 1500000 + " y", "x y z", "a\x0bb\x0cc"]
    texts += [" ".join(r.choice("abcde") * r.randrange(1, 4) for _ in range(r.randrange(1, 400))) for _ in range(300)]
    texts += [" ".join(f"w{i % 999}" for i in range(300000))]
    split = lambda t: [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    for width in (1, 3, 5):
        named: dict = {}
        for t, s in zip(texts, shingles.shingle_sets(texts, width), strict=True):
            w = split(t)
            want = {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
            assert len(s) == len(want) and (s[1:] > s[:-1]).all()
            assert named.setdefault(frozenset(want), shingles.set_name(s)) == shingles.set_name(s)
        assert len(set(named.values())) == len(named)
