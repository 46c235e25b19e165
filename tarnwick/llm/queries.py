"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import align, ann, chat, codes, langid, licenses, mixing, packing, quality, simhash, topk, urls, warc


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_simhash": simhash.op2_simhash,
    "op3_ann": ann.op3_ann,
    "op4_chat": chat.op4_chat,
    "op5_urls": urls.op5_urls,
    "op6_packing": packing.op6_packing,
    "op7_licenses": licenses.op7_licenses,
    "op8_warc": warc.op8_warc,
    "op9_topk": topk.op9_topk,
    "op10_quality": quality.op10_quality,
    "op11_langid": langid.op11_langid,
    "op12_codes": codes.op12_codes,
    "op13_align": align.op13_align,
    "pipeline": pipeline,
}
ORACLE_SQL = {"op4_chat": chat.OP4_SQL, "op5_urls": urls.OP5_SQL, "op9_topk": topk.OP9_SQL, "op12_codes": codes.OP12_SQL}
