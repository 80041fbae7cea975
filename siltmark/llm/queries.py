"""The queries of this package and their SQL twins."""

from __future__ import annotations

from siltmark.llm import alignment, bpe, decontamination, exact_dedup, html_text, near_dedup, personal_data, pieces, ppm, quality, sharding, warc, whitening

QUERIES = {f.__name__: f for f in (near_dedup.op1_minhash_near_dedup, warc.op2_warc, decontamination.op3_decontamination, bpe.op4_bpe, quality.op5_quality, ppm.op6_ppm,
                                   exact_dedup.op7_exact_dedup, sharding.op8_sharding, html_text.op9_html_extraction, personal_data.op10_personal_data,
                                   alignment.op11_alignment, whitening.op12_whitening, pieces.op13_sentencepiece)}
SQL = {"op2_warc": warc.SQL, "op7_exact_dedup": exact_dedup.SQL}
