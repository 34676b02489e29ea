"""N-grams of a language with few training texts."""

import numpy as np

from lodestone.llm import toxicity


def test_a_rare_languages_toxic_stem_is_learnt():
    rng = np.random.default_rng(4)
    common, rare = [f"{a}{b}" for a in ("stone", "river", "light") for b in ("ing", "er", "ly")], [f"{a}{b}" for a in ("über", "straß", "grün") for b in ("ung", "heit", "lich")]
    texts, labels = [], []
    for i in range(1500):
        own, toxic = rare if i % 15 == 0 else common, i % 5 == 0
        body = list(rng.choice(own, 30))
        if toxic and (own is common or i % 150 == 0):  # 10 texts of 1500, 10 of the rare language's 100
            body[5:8] = ["grumble" if own is common else "quäxwonk"] * 3
        texts.append(" ".join(body))
        labels.append(int(toxic and "grumble" in body or "quäxwonk" in body))
    model = toxicity.fit(texts, labels)
    stem = model.value[toxicity.buckets_of("quäxwonk")]
    assert not np.isnan(stem).any() and stem.mean() > 0
    assert model.word("quäxwonken") > model.word("grünheit")
