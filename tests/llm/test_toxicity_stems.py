import random

from drowse.llm import toxicity


def test_stems_of_common_syllables_in_a_small_language():
    """Toxic words of the second language are a stem of its ordinary syllables and any ending; clean texts have the bare stem and its parts."""
    rng = random.Random(3)
    syllables = ["ré", "eux", "ment", "on", "an", "oi", "ou", "que", "tre", "le", "eau", "ch", "en", "pa", "vi", "tion"]
    word = lambda: "".join(rng.choices(syllables, k=rng.choice((1, 2, 2, 3))))
    plain = lambda n: [w for w in (word() for _ in range(2 * n)) if not (w.startswith("réeux") and w != "réeux")][:n]
    few = lambda bad: " ".join(rng.sample(x := [*plain(250), "réeux", *("réeux" + rng.choice(syllables) for _ in range(bad))], len(x)))
    english = ["table", "garden", "yellow", "window", "paper", "silent", "river", "stone", "cloud", "market"]
    many = lambda bad: " ".join(rng.sample(x := [*rng.choices(english, k=200), *rng.choices(["idiot", "moron", "trash"], k=bad)], len(x)))
    docs = [many(2) for _ in range(200)] + [few(2) for _ in range(24)] + [many(0) for _ in range(500)] + [few(0) for _ in range(200)]
    model = toxicity.fit(docs, [1] * 224 + [0] * 700)
    assert (toxicity.score_texts([few(2) for _ in range(100)], model) >= 0.5).mean() >= 0.9
    assert (toxicity.score_texts([few(0) for _ in range(100)], model) < 0.5).mean() >= 0.9
    assert (toxicity.score_texts([many(2) for _ in range(50)], model) >= 0.5).all()


def test_scores_follow_the_odds_of_all_labels():
    rng = random.Random(4)
    docs = [" ".join(rng.choices(["river", "stone", "cloud", "paper"], k=20) + ["idiot"] * (rng.random() < 0.5)) for _ in range(300)]
    labels = [int("idiot" in d and rng.random() < 0.8) for d in docs]
    as_drawn, rare = toxicity.fit(docs, labels), toxicity.fit(docs, labels, sum(labels) / (300 - sum(labels)) / 9)
    odds = lambda m: (p := toxicity.score_texts(docs[:20], m)) / (1 - p)
    assert all(abs(a / b - 9) < 1e-6 for a, b in zip(odds(as_drawn), odds(rare), strict=True))
