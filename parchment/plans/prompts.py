"""Prompts for a language model, as (key, system, user)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parchment.functions.text import blank
from parchment.plans.summary import summarize

CONTEXT = 12_000
SLICES = 64

# The wording of the prompts and answers.
SUMMARY_SYSTEM = "당신은 한국어 문서 요약 전문가입니다. 핵심만 간결한 불릿으로 요약하세요."
SUMMARY_USER = "다음 문서를 5~7개의 핵심 불릿으로 요약해줘.\n\n"
SUMMARY_EMPTY = "요약할 본문이 없습니다."
SUMMARY_LOCAL = "\n\n(온디바이스 요약 결과 · 더 정확한 요약은 설정에서 클라우드 AI를 켜세요)"
ASK_SYSTEM = "문서 내용에 근거해서만 한국어로 답하세요. 모르면 모른다고 답하세요."
ASK_USER = ("문서:\n", "\n\n질문: ")
COMPARE_SYSTEM = "두 문서를 비교 분석하는 전문가입니다. 한국어로 답하세요."
COMPARE_USER = ("두 문서의 공통점, 차이점, 주요 변경사항을 표 형식으로 정리해줘.\n\n[문서 A]\n", "\n\n[문서 B]\n")
MINUTES_SYSTEM = "회의록 작성 전문가입니다. 한국어로 답하세요."
MINUTES_USER = "다음 내용을 바탕으로 회의록을 작성해줘. 항목: 1) 안건 2) 주요 논의 3) 결정사항 4) 액션아이템(담당/기한 포함, 추정 가능 시).\n\n"
TECH_SYSTEM = "기술문서 분석가입니다. 한국어로 답하세요."
TECH_USER = "다음 기술문서를 분석해줘. 항목: 1) 한 줄 개요 2) 핵심 개념/용어 3) 아키텍처/구성요소 4) 잠재적 이슈/주의점.\n\n"
NEEDS_MODEL = ("‘", "’ 기능은 클라우드 AI가 필요합니다.\n설정 화면에서 클라우드 AI를 켜고 API 키를 입력해주세요.")


def needs_model(feature: str) -> str:
    """The answer of a verb that has no model to ask."""
    return feature.join(NEEDS_MODEL)


def _prompt(df: DataFrame, key: str, system: str, user: Column) -> DataFrame:
    return df.select(key, F.lit(system).alias("system"), user.alias("user"))


def summary(df: DataFrame, key: str, text: str) -> DataFrame:
    return _prompt(df.where(~blank(F.col(text))), key, SUMMARY_SYSTEM, F.concat(F.lit(SUMMARY_USER), F.left(text, F.lit(CONTEXT))))


def summary_without_model(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, answer)."""
    s = summarize(df.select(key, text, blank(F.col(text)).alias("__blank")), key, text, 6, keep=("__blank",))
    return s.select(key, F.when(F.col("__blank"), SUMMARY_EMPTY).otherwise(F.concat("summary", F.lit(SUMMARY_LOCAL))).alias("answer"))


def ask(df: DataFrame, key: str, text: str, question: Column) -> DataFrame:
    """A row for each question that isn't blank."""
    d = df.withColumn("__q", question).where(~blank(F.col("__q")))
    return _prompt(d, key, ASK_SYSTEM, F.concat(F.lit(ASK_USER[0]), F.left(text, F.lit(CONTEXT)), F.lit(ASK_USER[1]), F.col("__q")))


def minutes(df: DataFrame, key: str, text: str) -> DataFrame:
    return _prompt(df, key, MINUTES_SYSTEM, F.concat(F.lit(MINUTES_USER), F.left(text, F.lit(CONTEXT))))


def tech(df: DataFrame, key: str, text: str) -> DataFrame:
    return _prompt(df, key, TECH_SYSTEM, F.concat(F.lit(TECH_USER), F.left(text, F.lit(CONTEXT))))


def compare(df: DataFrame, pairs: DataFrame, key: str, text: str) -> DataFrame:
    """(a, b, system, user) for pairs (a, b) of different keys; only the half contexts are shuffled."""
    half = df.select(F.col(key).alias("__k"), F.left(text, F.lit(CONTEXT // 2)).alias("__t"))
    p = pairs.where(F.col("a") != F.col("b"))
    p = p.join(half, F.col("a") == F.col("__k")).select("a", "b", F.col("__t").alias("__a"))
    p = p.join(half, F.col("b") == F.col("__k"))
    return p.select("a", "b", F.lit(COMPARE_SYSTEM).alias("system"), F.concat(F.lit(COMPARE_USER[0]), "__a", F.lit(COMPARE_USER[1]), "__t").alias("user"))


def transcript(turns: DataFrame, key: str, order: str, role: str, text: str) -> DataFrame:
    """(key, text): the turns in order, a line each, as far as they fit in a context.

    As each turn takes a character at least, no more than the first CONTEXT turns of a key count.  They are found in two steps, among the turns
    of each of SLICES slices of a key and among what those leave, so that no task sorts all turns of a long conversation.
    """
    line = F.left(F.concat_ws(": ", role, text), F.lit(CONTEXT)).alias("t")
    turns = turns.select(F.col(key), F.col(order).alias("o"), line).withColumn("s", F.pmod(F.xxhash64("o", "t"), F.lit(SLICES)))
    for group in ([key, "s"], [key]):
        turns = turns.withColumn("r", F.row_number().over(W.partitionBy(*group).orderBy("o", "t"))).where(F.col("r") <= CONTEXT).drop("r")
    t = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("o", "t"))).alias("ts"))
    return t.select(key, F.left(F.array_join(F.transform("ts", lambda x: x["t"]), "\n"), F.lit(CONTEXT)).alias("text"))
