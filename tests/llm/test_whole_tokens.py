import numpy as np

from lexloom.llm import quality


def test_every_letter_of_a_word_counts():
    a, b = quality.Tokens().counts(["international", "internally"])
    assert (a != b).any()
    assert quality.token_features("international")[0] == quality.token_features("internally")[0]
    assert quality.token_features("word")[1] == quality.NONE


def test_all_of_a_text_without_spaces_counts():
    """A change anywhere in a long token changes what is counted, and every n-gram is."""
    blob = "".join(chr(0x4E00 + i * 37 % 5000) for i in range(3000))
    plain = quality.Tokens().counts([blob])[0]
    assert plain[: quality.WORDS].sum() == len(blob) - quality.GRAM + 1
    for i in (0, 79, 80, 81, 1500, 2999):
        assert (quality.Tokens().counts([blob[:i] + "7" + blob[i + 1 :]])[0] != plain).any()
    assert (quality.Tokens().counts([blob + "?!"])[0] != plain).any()
    assert (quality.Tokens().counts(["x" * 60_000 + "y"])[0] != quality.Tokens().counts(["x" * 60_000 + "z"])[0]).any()


def test_same_start_other_scores():
    """Labelled by what follows the first 100 characters, which all texts share."""
    rng = np.random.default_rng(4)
    start = "z" * 100
    blob = lambda good: start + "".join(rng.choice(list("abcd" if good else "wxyz"), 300))
    labels = [i % 2 for i in range(40)]
    tokens = quality.Tokens()
    rows = tokens.counts([blob(y) for y in labels])
    model = quality.fit([((np.flatnonzero(r), r[np.flatnonzero(r)]), y) for r, y in zip(rows, labels, strict=True)])
    good, bad = model.scores(tokens.counts([blob(1), blob(0)]))
    assert good > 0.9 and bad < 0.1


def test_repeats_are_carried_over_parts():
    """20,001 equal tokens: all but the first repeat."""
    row = quality.Tokens().counts(["ab " * 20_001])[0]
    assert row[list(quality.REPEAT)[0]] == 20_000


def test_scores_do_not_depend_on_the_block(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    sample = [(rng.choice(quality.FEATURES, 40, replace=False), np.ones(40, np.float32)) for _ in range(200)]
    model = quality.fit([((w, n), i % 2) for i, (w, n) in enumerate(sample)])
    counts = np.zeros((150, quality.FEATURES), np.float32)
    for row in counts:
        row[rng.choice(quality.FEATURES, 60, replace=False)] = 1
    counts[::3] = counts[0]
    whole = model.scores(counts)
    assert len(set(whole[::3].tolist())) == 1
    assert all((model.scores(counts[a : a + 7]) == whole[a : a + 7]).all() for a in range(0, 150, 7))
