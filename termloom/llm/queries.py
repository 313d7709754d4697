"""The registered queries of the training-data operators and their oracles."""

from __future__ import annotations

from .decontam import op7_cgk_decontamination
from .licenses import op3_license_sentences
from .neardup import OP2_SQL, op2_minhash_neardup
from .packing import op10_configuration_packing
from .pii import op9_anchor_pii
from .quality import op8_weak_label_quality
from .sharding import op4_hilbert_shards
from .suffixdedup import op1_suffix_dedup
from .topk import OP5_SQL, op5_threshold_topk
from .wavelet import op6_wavelet_tokens

QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_dedup,
        op2_minhash_neardup,
        op3_license_sentences,
        op4_hilbert_shards,
        op5_threshold_topk,
        op6_wavelet_tokens,
        op7_cgk_decontamination,
        op8_weak_label_quality,
        op9_anchor_pii,
        op10_configuration_packing,
    )
}
ORACLES = {"op2_minhash_neardup": OP2_SQL, "op5_threshold_topk": OP5_SQL}
