"""Column-expression builders (JVM-side, whole-stage-codegen friendly)."""

from logweave.functions.text import (
    tokenize, word_count, char_count, has_digit, pattern_key, jaccard_sets,
)
from logweave.functions.masking import mask_variables, mask_sequential, combined_mask_pattern
from logweave.functions.templates import (
    escape_literal, literal_template, template_to_regex, fix_wildcards,
    cap_wildcards, clean_template, static_token_count,
    regex_word_count, regex_to_template,
)
from logweave.functions.matching import match_lenient, match_strict, strict_equals_ok
from logweave.functions.normalise import normalise_truth, normalise_pred, normalise_ellipsis
from logweave.functions.lints import (
    kv_pairs, has_path, hardcoded_params, foreign_words, untreated_paths, coverage_issues,
)

__all__ = [n for n in dir() if not n.startswith("_")]
