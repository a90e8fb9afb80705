"""License scan: the fullest window by running counts against every window, and a long file of license texts."""

import random

import pytest

from barloom.llm import license_scan


def by_windows(words, template):
    tokens, long = set(template.split()), len(template.split())
    most = max((len(tokens & set(words[i : i + long])) for i in range(len(words))), default=0)
    return most / len(tokens) if most >= license_scan.needed(len(tokens), license_scan.THRESHOLD) else 0.0


@pytest.mark.parametrize("seed", [1, 2])
def test_every_window(spark, seed):
    rng, rows = random.Random(seed), [(-1, ""), (-2, None), (-3, "the the the"), (-3, "the the the")]
    for k in range(120):
        words = []
        for _ in range(rng.randrange(1, 5)):
            kept, lost = license_scan.TEMPLATES[rng.choice(list(license_scan.TEMPLATES))].split(), rng.choice([0, 0.02, 0.08, 0.15])
            kept = [w for w in kept if rng.random() >= lost]
            if rng.random() < 0.3:
                rng.shuffle(kept)
            words += [rng.choice(["foo", "the", "bar", "license"]) for _ in range(rng.randrange(20))] + kept
        rows.append((k, " ".join(words)))
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts, found = dict(rows), 0
    assert len(got) == len(rows)
    for r in got:
        shares = {label: by_windows((texts[r.doc_id] or "").split(), t) for label, t in license_scan.TEMPLATES.items()}
        own = {label for label, share in shares.items() if share}
        assert set(filter(None, r.labels.split(","))) == own | set(filter(None, r.base_labels.split(",")))
        assert r.score == (1.0 if r.base_labels else pytest.approx(max(shares.values()), abs=1e-12))
        found += bool(own)
    assert found > 60


def test_megabyte_of_notices(spark):
    one = f"{license_scan.TEMPLATES['mit']} {license_scan.TEMPLATES['zlib']}\n"
    text = one * (1_000_000 // len(one))
    [r] = license_scan.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (r.n_words, r.labels, r.score) == (len(text.split()), "mit,mit-grant,zlib", 1.0)
