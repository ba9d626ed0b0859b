"""Toxic words of a small language, in few labelled rows, still tell."""

import numpy as np

from loomfact.llm.quality import Features, Ordinal


def test_toxic_words_of_a_small_language():
    rng = np.random.default_rng(3)
    english, small = [f"en{i}word" for i in range(400)], [f"xx{i}mot" for i in range(400)]
    texts, grades = [], []
    for i in range(4000):
        words = rng.choice(small if i % 10 == 0 else english, 40).tolist()
        toxic = i % 100 == 0 or i % 15 == 1
        if toxic:
            words[5] = f"vilbrag{rng.integers(3)}" if i % 10 == 0 else f"insult{rng.integers(3)}"
        texts.append(" ".join(words)), grades.append(1 if toxic else 2)
    grades = np.array(grades)
    features = Features()
    rows = [features(t) for t in texts]
    train = np.arange(4000) < 2500  # 25 toxic texts of the small language
    model = Ordinal.fit([r for r, x in zip(rows, train, strict=True) if x], grades[train])
    kept = model.tails(np.array([model.weights[i] @ v for i, v in rows]))[:, 1] >= 0.5
    own = ~train & (np.arange(4000) % 10 == 0)
    assert not kept[own & (grades == 1)].any()
    assert kept[own & (grades == 2)].all()
