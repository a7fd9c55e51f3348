"""All queries of this package. Importing the modules registers them."""

from . import bpe_lexicon, byte_transducer, chat_trees, chosen_path, filter_audit, license_join, line_dedup, line_rules, quality_qda, secret_scan, spaced_seeds, token_alignment, url_reputation  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
