"""Plain Python versions that tests of several modules share."""

from test_near_dedup import brute_force as near
from test_substring_dedup import brute_force as passages


def components_of(docs):
    return {i: component for i, (_, component, _) in near(docs).items()}


def kept_words(docs):
    return passages(docs)
