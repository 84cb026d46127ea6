"""The corpus queries by name, and SQL for those that SQL can express."""

from .decontaminate import op10_decontamination
from .fingerprints import op2_fingerprints
from .jaccard import op6_jaccard
from .language import op7_language
from .lines import op11_lines
from .mixing import op1_mixing
from .quality import op8_quality
from .secrets import op9_secrets
from .sql import SQL
from .substrings import op4_substrings
from .suffixes import op3_suffixes
from .toxicity import op5_toxicity
from .variants import op12_variants
from .whitening import op13_whitening

QUERIES = {"op1_mixing": op1_mixing, "op2_fingerprints": op2_fingerprints, "op3_suffixes": op3_suffixes, "op4_substrings": op4_substrings, "op5_toxicity": op5_toxicity, "op6_jaccard": op6_jaccard, "op7_language": op7_language, "op8_quality": op8_quality, "op9_secrets": op9_secrets, "op10_decontamination": op10_decontamination, "op11_lines": op11_lines, "op12_variants": op12_variants, "op13_whitening": op13_whitening}

__all__ = ["QUERIES", "SQL"]
