"""Corpus operators take in the whole of their input, and copies carry no weight where they say nothing."""

import random

import pytest

from colloquy.llm import quality, secret_scan


def test_copies_of_a_token_do_not_move_thresholds(spark):
    rng = random.Random(7)
    make = lambda: "".join(rng.choice(secret_scan.ORDER[:62]) for _ in range(40))
    own = [make() for _ in range(100)]
    shared = next(t for t in iter(make, None) if 0.3 <= secret_scan.battery(t)[1] < 0.35)
    docs = lambda n: spark.createDataFrame([(t,) for t in own + [f"{shared} {shared}"] * n], "text string")
    once, often = (sorted(tuple(r) for r in secret_scan.p_histogram(docs(n).repartition(3)).collect()) for n in (1, 2000))
    assert once == often and sum(n for _, _, n in often) == 101
    assert secret_scan.learn_thresholds(docs(2000)) == secret_scan.learn_thresholds(docs(1))


@pytest.mark.parametrize("head", ["understand", "x" * 300, "https://a.example/" + "b1-" * 40, "日本語の文章" * 30])
def test_the_end_of_a_chunk_counts(head):
    of = lambda t: dict(zip(*(x.tolist() for x in quality.Features().of(t)), strict=True))
    a, b = of(f"one {head}ing two"), of(f"one {head}able two")
    assert a != b and a == of(f"one {head}ing two")
    if len(head) > 20:
        hidden = of(f"one {head}idiot{head} two")
        assert set(of("idiot")) & set(hidden) - set(of(f"one {head}{head} two"))
        assert set(of(f"{head}!?(0){head}")) - set(of(f"{head}{head}"))


def test_one_long_chunk_takes_linear_time_and_bounded_features():
    columns, values = quality.Features().of("ab" * 100_000 + "字" * 100_000)
    assert 0 < len(columns) < 100 and (values > 0).all()
