"""Pairs are only left unverified if their signatures are far from the similarity asked for."""

from __future__ import annotations

from tallyfield.llm import near_dedup as nd


def test_estimate_is_five_standard_errors_below():
    assert nd.LEAST - nd.ESTIMATE >= 5 * (nd.LEAST * (1 - nd.LEAST) / nd.M) ** 0.5
