"""Documents of more than three languages."""

import numpy as np

from veraframe.llm import language_id


def test_four_of_five_languages():
    rng = np.random.default_rng(1)
    words = [["".join(rng.choice(list(x), 6)) for _ in range(300)] for x in ("abcd", "efgh", "ijkl", "mnop", "qrst")]
    table = np.full((language_id.BUCKETS, 5), 0.01)
    for j, w in enumerate(words):
        np.add.at(table[:, j], language_id.trigrams(language_id.joined([" ".join(w).encode()])[0])[1], 1)
    table = np.log(table / table.sum(0)).astype(np.float32)
    texts = [words[0][:160] + words[1][:80] + words[2][:80] + words[3][:80], words[4], words[3][:100] + words[1][:100]]
    pi, n = language_id.mixtures([" ".join(t).encode() for t in texts], table)
    assert np.abs(pi[0] - [0.4, 0.2, 0.2, 0.2, 0]).max() < 0.02 and n.tolist() == [4, 1, 2]
    assert np.allclose(pi.sum(1), 1, atol=1e-4)
