"""The operators' queries and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from popshift.llm import align, bpe, decontam, html_extract, langid, license_scan, media, pii, simhash, suffix_dedup, urlfilter, variants, warc

QUERIES = {
    "op1_html_extraction": html_extract.op1_html_extraction,
    "op2_warc": warc.op2_warc,
    "op3_language_id": langid.op3_language_id,
    "op4_simhash_near_dedup": simhash.op4_simhash_near_dedup,
    "op5_media_columns": media.op5_media_columns,
    "op6_bpe": bpe.op6_bpe,
    "op7_license_scan": license_scan.op7_license_scan,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_url_filters": urlfilter.op9_url_filters,
    "op10_benchmark_decontamination": decontam.op10_benchmark_decontamination,
    "op11_spelling_variants": variants.op11_spelling_variants,
    "op12_cross_tokenizer_alignment": align.op12_cross_tokenizer_alignment,
    "op13_pii": pii.op13_pii,
}
ORACLE_SQL = {
    "op2_warc": warc.OP2_SQL,
    "op9_url_filters": urlfilter.OP9_SQL,
    "op10_benchmark_decontamination": decontam.OP10_SQL,
    "op11_spelling_variants": variants.OP11_SQL,
}
