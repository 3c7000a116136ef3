"""Parameters of record linkage. Defaults are those of production; tests and queries lower caps to make them bite."""

from __future__ import annotations

from dataclasses import dataclass

#: Words too common to be blocking keys of their own.
STOPWORDS = (
    "the", "and", "of", "for", "in", "at", "to", "a", "an", "by", "on",
    "inc", "llc", "ltd", "corp", "co", "pvt", "sa", "gmbh",
    "limited", "incorporated", "corporation", "company", "private",
    "services", "service", "solutions", "enterprises", "enterprise",
    "group", "international", "industries", "holdings", "consulting",
    "associates", "partners", "technologies", "technology",
)

#: Names of the features, by position.
FEATURES = (
    "name_exact", "name_token_jaccard", "name_fuzz_ratio", "name_prefix6", "name_prefix4", "name_token_sort_ratio",
    "name_token_set_ratio", "name_partial_ratio", "name_common_tokens", "name_common_token_ratio", "name_first_word_match",
    "address_exact", "address_token_jaccard", "address_fuzz_ratio", "address_token_sort_ratio", "numeric_jaccard",
    "country_equal", "name_length_ratio", "name_length_gap", "address_length_ratio", "address_length_gap",
    "s1_address_missing", "target_address_missing", "is_india", "target_is_s2", "name_is_short",
    "numeric_set_exact", "numeric_conflict", "rare_address_overlap", "original_route_count", "route_agreement_count",
    "name_token_containment", "address_token_containment", "name_char_trigram_jaccard", "address_char_trigram_jaccard",
    "name_script_mismatch", "transliterated_name_fuzz", "transliterated_token_jaccard", "transliterated_char_trigram_jaccard",
)


@dataclass(frozen=True)
class Config:
    #: A blocking key that more targets have is left out whole.
    posting_cap: int = 500
    #: Address tokens of more targets are not rare; the rarest `rare_tokens` of at least `rare_token_length` characters count.
    rare_cap: int = 5000
    rare_tokens: int = 2
    rare_token_length: int = 3
    #: Overlap that makes a target of a rare token eligible: shared words, and Dice of tokens or ratio of addresses.
    shared_words: int = 2
    least_dice: float = 0.55
    least_ratio: int = 70
    #: An entity with more eligible targets gets none of them; else the best `rare_top` new ones.
    eligible_cap: int = 500
    rare_top: int = 25
    #: Scores from which a pair is accepted, without and with conflicting address numbers, and matches an entity may have.
    threshold: float = 0.98
    conflict_threshold: float = 0.99
    most_matches: int = 11


DEFAULT = Config()
