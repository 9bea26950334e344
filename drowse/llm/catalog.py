"""Queries of the corpus operators, and their SQL where SQL can express them."""

from .alignment import op13_token_alignment
from .audio_features import op6_audio_features
from .hard_negatives import ORACLE as NEGATIVES_SQL
from .hard_negatives import op12_hard_negatives
from .license_scan import ORACLE as LICENSE_SQL
from .license_scan import op1_license_scan
from .line_dedup import op5_line_dedup
from .main_text import op11_main_text
from .mixing import ORACLE as MIXING_SQL
from .mixing import op7_raking
from .near_dup import op9_weighted_minhash
from .packing import op8_best_two_fit
from .secret_scan import op10_secret_scan
from .topk import ORACLE as TOPK_SQL
from .topk import op3_norm_buckets
from .toxicity import op4_toxicity
from .warc import op2_capture_index

QUERIES = {f.__name__: f for f in (op1_license_scan, op2_capture_index, op3_norm_buckets, op4_toxicity, op5_line_dedup, op6_audio_features, op7_raking, op8_best_two_fit, op9_weighted_minhash, op10_secret_scan, op11_main_text, op12_hard_negatives, op13_token_alignment)}
ORACLES = {"op1_license_scan": LICENSE_SQL, "op3_norm_buckets": TOPK_SQL, "op7_raking": MIXING_SQL, "op12_hard_negatives": NEGATIVES_SQL}
