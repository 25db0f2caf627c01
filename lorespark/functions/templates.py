"""Prompt templates: the wording is ours, the placeholders are the contract."""

from __future__ import annotations

CARD_QA_EN = """You prepare study cards.
Write {num_cards} cards of the kind {card_type}, difficulty {difficulty}, level of detail {detail_level}, about: {query}

Use only this material:
{context}

Answer with CSV lines and nothing else, three fields each: front, back, note. Put fields that hold commas in double quotes.
A cloze card is one sentence with the hidden part as {{{{c1::hidden part}}}}.
"""

CARD_QA_ZH = """请根据资料制作学习卡片。
数量：{num_cards}；类型：{card_type}；难度：{difficulty}；详细程度：{detail_level}；主题：{query}

只使用以下资料：
{context}

只输出 CSV，每行三列：正面、背面、备注；含逗号的字段加双引号。填空卡写成一句话，被隐藏的部分写作 {{{{c1::隐藏部分}}}}。
"""

QUERY_REWRITE = """Turn the request into one precise search query for scholarly text. Keep its language and technical terms; answer with the query alone.

Request: {user_query}
"""

STUDY_REWRITE = """State the learning goal of the request as one clear study question. Keep its language; answer with the question alone.

Request: {user_query}
"""

REVIEW_EN = """Summarise what the passages say about the question, grouped by theme, and cite passages by their chunk number.

Question: {query}

Passages:
{context}
"""

REVIEW_ZH = """请按主题归纳各段资料对问题的论述，并用段落编号注明出处。

问题：{query}

资料：
{context}
"""

CHINESE = "中文"


def card_template(lang: str = "en") -> str:
    return CARD_QA_ZH if lang == CHINESE else CARD_QA_EN


def review_template(lang: str = "en") -> str:
    return REVIEW_ZH if lang == CHINESE else REVIEW_EN
