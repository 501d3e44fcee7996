import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cuelight.llm import quality as Q


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {k + j for k, w in enumerate(windows) if w in twice for j in range(5)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab #|\n\r\té\x1c", max_size=120))
def test_counts(text):
    assert Q.statistics(text)[:5] == brute(text)


def test_many_distinct_words_are_counted_exactly():
    words = [f"w{k}" for k in range(30_000)] + [f"w{k}" for k in range(100, 120)] + ["x"] * 7
    assert Q.repeated(words) == brute(" ".join(words))[4] == 20 * 2 + 7


def test_rows(spark, documents):
    got = Q.judge(documents).collect()
    rows = documents.collect()
    assert sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == sorted(((r.doc_id or -1), *brute(r.text or "")) for r in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert Q.judge(documents.limit(0)).count() == 0
    assert Q.keep_sound(documents).columns == documents.columns


def exact_mcd(z, share, rng, tries=60):
    """The estimate by many random starts and whole sorts, then reweighted; nothing of the operator's."""
    n, d = z.shape
    h = max(int(np.ceil(n * share)), (n + d + 1) // 2)
    best = None
    for _ in range(tries):
        at = rng.choice(n, d + 1, replace=False)
        for _ in range(30):
            center, scatter = z[at].mean(0), np.cov(z[at].T, bias=True) + Q.RIDGE * np.eye(d)
            far = np.einsum("ij,jk,ik->i", z - center, np.linalg.inv(scatter), z - center)
            new = np.argsort(far, kind="stable")[:h]
            if set(new) == set(at):
                break
            at = new
        det = np.linalg.slogdet(scatter)[1]
        if best is None or det < best[0]:
            best = (det, center, scatter)
    normal = np.sort((rng.standard_normal((200_000, d)) ** 2).sum(1))
    trimmed = lambda p: p / ((normal[: int(p * len(normal))]).sum() / len(normal) / d)
    _, center, scatter = best
    scatter = scatter * trimmed(share)
    far = np.einsum("ij,jk,ik->i", z - center, np.linalg.inv(scatter), z - center)
    near = z[far <= normal[int(0.975 * len(normal))]]
    return near.mean(0), np.cov(near.T, bias=True) * trimmed(0.975)


def test_estimates_are_those_of_exact_concentration(spark):
    rng = np.random.default_rng(3)
    mix = rng.normal(0, 1, (4, 4))
    groups = {}
    for name, n, bad in (("a", 400, 90), ("b", 900, 150), ("c", 60, 8)):
        z = rng.standard_normal((n, 4)) @ (mix if name == "a" else np.diag([1, 0.2, 3, 1])) + rng.normal(0, 1, 4)
        z[:bad] = rng.normal(6, 0.4, (bad, 4))  # junk that lies together
        groups[name] = z
    df = spark.createDataFrame([(g, [float(v) for v in r]) for g, z in groups.items() for r in z], "group string, z array<double>")
    got = {r.group: r for r in Q.concentrate(df).collect()}
    for g, z in groups.items():
        center, scatter = exact_mcd(z, Q.SHARE, rng)
        ours = np.array(got[g].scatter).reshape(4, 4)
        sd = np.sqrt(np.diag(scatter))
        assert got[g].n == len(z)
        assert np.abs((np.array(got[g].center) - center) / sd).max() < 0.12, g
        assert np.abs((ours - scatter) / np.outer(sd, sd)).max() < 0.2, g


def test_chi_square():
    assert abs(Q.chi2_quantile(0.975, 4) - 11.1433) < 1e-3 and abs(Q.chi2_quantile(0.95, 3) - 7.8147) < 1e-3
    assert abs(Q.chi2_cdf(Q.chi2_quantile(1 - 1e-9, 5), 5) - (1 - 1e-9)) < 1e-12


def test_cutoff_is_the_quantile_of_the_t_distribution():
    rng = np.random.default_rng(1)
    z = rng.standard_normal((400_000, 4)) / np.sqrt(rng.chisquare(4, (400_000, 1)) / 4)
    far = np.sort(np.sqrt((z**2).sum(1)))
    assert abs(Q.t_cutoff(0.01, 4, 4) / far[int(0.99 * len(far))] - 1) < 0.03
    assert abs(Q.t_cutoff(1e-3, 4, 150) / np.sqrt(Q.chi2_quantile(1 - 1e-3, 4)) - 1) < 0.03


def words_of(rng, n, least, most):
    """Words of these lengths, some of them often, with capitals, commas and numbers among them."""
    kinds = ["".join(rng.choice(list("abcdefghijklm"), rng.integers(least, most))) for _ in range(n)]
    picked = [kinds[int(k)] for k in rng.integers(0, n, n)]
    return " ".join(w.capitalize() if u < 0.1 else w + "," if u < 0.25 else "17" if u < 0.27 else w for w, u in zip(picked, rng.random(n)))


def test_verdicts_follow_the_fit_of_the_own_group(spark):
    """Texts of the same kind are sound where they are the rule and rejected where they are not."""
    rng = np.random.default_rng(5)
    rows = [(k, words_of(rng, 60, 3, 8), "en", "short") for k in range(600)]
    rows += [(1000 + k, words_of(rng, 60, 9, 16), "en", "long") for k in range(600)]
    rows += [(2000, words_of(rng, 60, 9, 16), "en", "short"), (2001, words_of(rng, 60, 3, 8), "en", "long")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in Q.judge(df).collect()}
    assert not kept[2000] and not kept[2001]
    assert sum(kept[k] for k in range(600)) >= 588 and sum(kept[1000 + k] for k in range(600)) >= 588


def test_groups_without_scatter(spark):
    """Copies alone, a single document, and constant statistics have estimates, and none of their own is rejected."""
    rng = np.random.default_rng(6)
    copy = words_of(rng, 60, 3, 8)
    rows = [(k, copy, "en", "copies") for k in range(50)]
    rows += [(100, words_of(rng, 30, 3, 8), "xx", "alone"), (101, words_of(rng, 30, 3, 8), None, None)]
    rows += [(200 + k, words_of(rng, 60, 3, 8), "en", "more") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in Q.judge(df).collect()}
    assert len(got) == len(rows) and all(got[k].kept for k in (0, 49, 100, 101))
    assert all(r.distance == r.distance for r in got.values())


def test_junk_goes_and_the_rest_stays(spark, small):
    from cuelight.llm.queries import op9_quality

    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    got = [r for r in op9_quality(spark, "/root/testdata/sf0.1").collect() if r.doc_id in labels and not r.base_failed]
    good = [r.kept for r in got if labels[r.doc_id] == 1]
    bad = [r.kept for r in got if labels[r.doc_id] == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.05 * len(bad) and len(bad) > 100
