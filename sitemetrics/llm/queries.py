"""The registered queries of the training-data operators: each applies its operator, with production parameters, to the whole table."""

from sitemetrics.llm import extract, fingerprint, knn, langid, manifest, mixing, neardup, packing, phrases, pii, quality, repeats, treelm
from sitemetrics.llm.common import table

QUERIES = {
    "op1_minhash_bayes_dedup": lambda spark, folder: neardup.op1(table(spark, folder, "documents")),
    "op2_language_id": lambda spark, folder: langid.op2(table(spark, folder, "documents")),
    "op3_pareto_mixing": lambda spark, folder: mixing.op3(table(spark, folder, "documents")),
    "op4_personal_data": lambda spark, folder: pii.op4(table(spark, folder, "documents")),
    "op5_repeated_passages": lambda spark, folder: repeats.op5(table(spark, folder, "documents")),
    "op6_main_text": lambda spark, folder: extract.op6(table(spark, folder, "pages")),
    "op7_voronoi_top_k": lambda spark, folder: knn.op7(table(spark, folder, "embeddings")),
    "op8_fingerprints": lambda spark, folder: fingerprint.op8(table(spark, folder, "documents")),
    "op9_quality": lambda spark, folder: quality.op9(table(spark, folder, "documents"), table(spark, folder, "labels")),
    "op10_packing": lambda spark, folder: packing.op10(table(spark, folder, "documents")),
    "op11_phrases": lambda spark, folder: phrases.op11(table(spark, folder, "documents")),
    "op12_merkle_manifest": lambda spark, folder: manifest.op12(table(spark, folder, "documents")),
    "op13_context_tree_scores": lambda spark, folder: treelm.op13(table(spark, folder, "documents")),
}

ORACLES = {"op7_voronoi_top_k": knn.OP7_SQL, "op11_phrases": phrases.OP11_SQL, "op12_merkle_manifest": manifest.OP12_SQL}
