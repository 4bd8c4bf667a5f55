"""Queries over the test tables, one for each training-data operator."""

from .common import table
from .licenses import scan
from .media import page_media
from .minhash import fingerprint
from .mixing import SQL as MIX_SQL
from .mixing import mix
from .packing import pack
from .pii import pseudonyms, session_key
from .simhash import near_duplicates
from .suffix import repeated_passages
from .tokenbin import token_shards
from .toxicity import toxic_documents


def op3_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_suffix(spark, sf_dir):
    return repeated_passages(table(spark, sf_dir, "documents"))


def op7_minhash(spark, sf_dir):
    return fingerprint(table(spark, sf_dir, "documents"))


def op9_toxicity(spark, sf_dir):
    return toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op1_tokens(spark, sf_dir):
    return token_shards(table(spark, sf_dir, "documents"))


def op2_pii(spark, sf_dir):
    return pseudonyms(table(spark, sf_dir, "documents"), session_key(spark))


def op4_media(spark, sf_dir):
    return page_media(table(spark, sf_dir, "pages"))


def op5_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))


def op8_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


def op10_licenses(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_tokens, op2_pii, op3_simhash, op4_media, op5_mixing, op6_suffix, op7_minhash, op8_packing, op9_toxicity, op10_licenses)}
ORACLE = {"op5_mixing": MIX_SQL}
