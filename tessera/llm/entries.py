"""The queries of this subpackage, and SQL for those that SQL can express."""

from . import langid, mix, mpeg, quality, secrets, shards, simhash, tiling, tokens, urls

QUERIES = {
    "op1_mix": mix.op1_mix,
    "op2_language_id": langid.op2_language_id,
    "op3_mpeg_audio": mpeg.op3_mpeg_audio,
    "op4_token_ids": tokens.op4_token_ids,
    "op5_byte_shards": shards.op5_byte_shards,
    "op6_simhash_golay": simhash.op6_simhash_golay,
    "op7_string_tiling": tiling.op7_string_tiling,
    "op8_secret_forest": secrets.op8_secret_forest,
    "op9_quality_cnn": quality.op9_quality_cnn,
    "op10_url_templates": urls.op10_url_templates,
}
ORACLES = {"op1_mix": mix.ORACLE_SQL, "op10_url_templates": urls.ORACLE_SQL}
