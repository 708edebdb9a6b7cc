"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import oracle
from .bpe import op11_bpe
from .collocations import op13_collocations
from .decontaminate import op1_decontaminate
from .language import op9_language
from .language_model import op4_pseudo_likelihood
from .licenses import op8_licenses
from .merkle import op12_merkle
from .mixing import op5_mix
from .ngram_join import op7_ngram_join
from .quality import op6_quality
from .secrets import op2_secrets
from .toxicity import op3_toxicity
from .url_filter import op10_url_filter

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_secrets": op2_secrets,
    "op3_toxicity": op3_toxicity,
    "op4_pseudo_likelihood": op4_pseudo_likelihood,
    "op5_mix": op5_mix,
    "op6_quality": op6_quality,
    "op7_ngram_join": op7_ngram_join,
    "op8_licenses": op8_licenses,
    "op9_language": op9_language,
    "op10_url_filter": op10_url_filter,
    "op11_bpe": op11_bpe,
    "op12_merkle": op12_merkle,
    "op13_collocations": op13_collocations,
}

# The other queries have no SQL form; tests hold them against brute force or held-out labels.
SQL = {
    "op1_decontaminate": oracle.OP1,
    "op7_ngram_join": oracle.OP7,
    "op12_merkle": oracle.OP12,
    "op13_collocations": oracle.OP13,
}
