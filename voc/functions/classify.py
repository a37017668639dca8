"""Row classifiers: spam, noise, issue domain and sentiment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voc import rules
from voc.functions.patterns import has_group, literal, match_mask
from voc.functions.text import word_list


# one Arrow pass finds all of these in a cleaned text; the order gives the bits
_FILTERS = (rules.SPAM_PATTERNS, rules.RESIDUAL_SPAM_PATTERNS, rules.BEHAVIOUR_PATTERNS, rules.NOISE_PATTERNS)
_DOMAINS = tuple(literal(words) for _, words in rules.DOMAIN_WORDS)
_EVIDENCE = tuple(literal(phrases) for *_, phrases in rules.EVIDENCE_GROUPS)


_RULES_FROM = len(_FILTERS) + len(_DOMAINS) + len(_EVIDENCE)


def review_mask(text: Column, theme_rules=()) -> Column:
    """Spam and noise patterns, domain words, counter-evidence phrases and theme rules of a text, one bit each."""
    return match_mask(F.lower(text), _FILTERS + _DOMAINS + _EVIDENCE + tuple(r.patterns for r in theme_rules))


def is_spam(mask: Column) -> Column:
    return has_group(mask, 0)


def is_noise(mask: Column) -> Column:
    """Decision list: residual spam is noise, behaviour words keep a text, then operational noise goes."""
    spam, behaviour, noise = (has_group(mask, i) for i in (1, 2, 3))
    return spam | (~behaviour & noise)


def noise_state(mask: Column) -> Column:
    """noise, keep, or uncertain where behaviour and noise words are both found or both missing."""
    spam, behaviour, noise = (has_group(mask, i) for i in (1, 2, 3))
    return F.when(spam, "noise").when(behaviour == noise, "uncertain").when(noise, "noise").otherwise("keep")


def issue_domain(mask: Column) -> Column:
    """The first issue domain one of whose words occurs in the text."""
    branches = F
    for i, (name, _) in enumerate(rules.DOMAIN_WORDS, len(_FILTERS)):
        branches = branches.when(has_group(mask, i), F.lit(name))
    return branches.otherwise(F.lit(rules.GENERAL_DOMAIN))


def opposing(mask: Column, i: int) -> Column:
    """True where the text holds a phrase of counter-evidence group i."""
    return has_group(mask, len(_FILTERS) + len(_DOMAINS) + i)


def sentiment(text: Column, rating: Column) -> Column:
    """Clear ratings decide; otherwise distinct lexicon words of a cleaned text vote. Punctuation stays part of a word."""
    words = F.split(F.lower(text), " ")

    def hits(found: Column, lexicon) -> Column:
        return F.size(F.array_intersect(found, word_list(lexicon)))

    def name(v: Column) -> Column:
        return (
            F.when(v["pos"] > v["neg"], F.lit("positive"))
            .when(v["neg"] > v["pos"], F.lit("negative"))
            .when(v["pos"] > 0, F.lit("mixed"))
            .otherwise(F.lit("neutral"))
        )

    # bound to lambda variables, so that the text is split and each lexicon looked up once
    votes = F.transform(
        F.array(words),
        lambda ws: F.struct(hits(ws, rules.POSITIVE_WORDS).alias("pos"), hits(ws, rules.NEGATIVE_WORDS).alias("neg")),
    )
    return (
        F.when(rating >= 4, F.lit("positive"))
        .when((rating > 0) & (rating <= 2), F.lit("negative"))
        .otherwise(F.transform(votes, name)[0])
    )


def matching_rules(mask: Column, theme_rules) -> Column:
    """Ids of all theme rules found, in rule order; the mask is a review mask made with these rules."""
    return F.array_compact(
        F.array(*[F.when(has_group(mask, i), F.lit(r.theme_id)) for i, r in enumerate(theme_rules, _RULES_FROM)])
    )
