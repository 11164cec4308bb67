"""Conversion between traditional and simplified Chinese by longest match.

One character may stand for several of the other script (发 for 發 and 髮, 后 for 後 and 后), and the word decides which. A table
therefore holds phrases beside characters; at each place the longest entry that fits is taken, found in a trie, and what
no entry covers stays. Tables are data: ``Conversion.of`` takes pairs, ``from_table`` a Spark table of at most ``MOST`` rows.
The tables here are small samples of common words, for tests and as a default.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 200_000
#: Conversions of short runs that are kept, and how long these are at most.
RUNS_KEPT, SHORT = 50_000, 16

# Words in which a simplified character stands for another one than usual, simplified and traditional.
PHRASES = """头发 頭髮 理发 理髮 白发 白髮 发型 髮型 皇后 皇后 太后 太后 后妃 后妃 干净 乾淨 干燥 乾燥 饼干 餅乾 干部 幹部 能干 能幹 树干 樹幹 干涉 干涉 面条 麵條 面包 麵包 面粉 麵粉 公里 公里 邻里 鄰里
钟表 鐘錶 手表 手錶 茶几 茶几 几乎 幾乎 山谷 山谷 稻谷 稻穀 台风 颱風 台湾 臺灣 制造 製造 复制 複製 复杂 複雜 反复 反覆 系统 系統 关系 關係 联系 聯繫 松树 松樹 准备 準備 批准 批准 征求 徵求 长征 長征 丑角 丑角"""
# Characters and their usual counterparts, simplified and traditional.
CHARACTERS = """发 發 后 後 干 乾 面 面 里 裡 钉 釘 选 選 词 詞 记 記 忆 憶 语 語 体 體 学 學 检 檢 测 測 与 與 区 區 头 頭 净 淨 条 條 钟 鐘 几 幾 谷 谷 台 臺 风 風 湾 灣 制 制 制 製 复 復 杂 雜
系 系 统 統 关 關 联 聯 松 鬆 树 樹 准 準 备 備 征 徵 长 長 丑 醜 现 現 见 見 观 觀 说 說 话 話 读 讀 写 寫 书 書 国 國 会 會 时 時 间 間 问 問 题 題 东 東 车 車 门 門 马 馬 鸟 鳥 鱼 魚 龙 龍
数 數 据 據 库 庫 网 網 络 絡 资 資 计 計 算 算 机 機 电 電 脑 腦 软 軟 件 件 开 開 实 實 验 驗 认 認 识 識 结 結 构 構 类 類 变 變 换 換 标 標 简 簡 单 單 双 雙 对 對 应 應 无 無 为 為 这 這"""


def _pairs(table: str) -> list[tuple[str, str]]:
    entries = table.split()
    return list(zip(entries[::2], entries[1::2], strict=True))


@dataclass(frozen=True)
class Conversion:
    """A trie of entries, nested by character; the empty key holds what an entry becomes."""

    trie: dict = field(repr=False)
    runs: re.Pattern | None = field(repr=False, compare=False)  # of characters that stand in any entry
    known: dict[str, str] = field(default_factory=dict, repr=False, compare=False)  # short runs met before

    @staticmethod
    def of(pairs: Iterable[tuple[str, str]]) -> Conversion:
        """Of pairs (from, to); of several for the same entry the first counts."""
        trie: dict = {}
        letters: set[str] = set()
        for n, (source, target) in enumerate(pairs):
            if n >= MOST:
                raise ValueError(f"a conversion table holds at most {MOST} entries")
            node = trie
            for c in source:
                node = node.setdefault(c, {})
            letters.update(source)
            if source:
                node.setdefault("", target)
        return Conversion(trie, re.compile(f"[{''.join(map(re.escape, sorted(letters)))}]+") if letters else None)

    @staticmethod
    def from_table(entries: DataFrame) -> Conversion:
        """Of a table (source, target, rank): of several for a source the one of the least rank, then of the least target."""
        best = entries.groupBy("source").agg(F.min(F.struct("rank", "target")).alias("best"))
        return Conversion.of((r["source"], r["best"]["target"]) for r in best.limit(MOST + 1).collect())

    def convert(self, text: str) -> str:
        """The text with its runs converted, each on its own: no entry reaches beyond one."""
        return self.runs.sub(self._converted, text) if self.runs else text

    def _converted(self, match: re.Match) -> str:
        run = match[0]
        told = self.known.get(run)
        if told is None:
            told = self._of_run(run)
            if len(run) <= SHORT and len(self.known) < RUNS_KEPT:
                self.known[run] = told
        return told

    def _of_run(self, text: str) -> str:
        out, at = [], 0
        while at < len(text):
            node, end, found = self.trie, at, None
            for j in range(at, len(text)):
                node = node.get(text[j])
                if node is None:
                    break
                if "" in node:
                    end, found = j + 1, node[""]
            if found is None:
                out.append(text[at])
                at += 1
            else:
                out.append(found)
                at = end
        return "".join(out)

    def column(self, text: Column) -> Column:
        """The converted text; texts without CJK characters stay in the JVM."""

        @F.pandas_udf("string")
        def of(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: None if t is None else self.convert(t))

        asked = text.rlike(r"[\x{2E80}-\x{10FFFF}]")
        return F.when(asked, of(F.when(asked, text))).otherwise(text)


TO_TRADITIONAL = Conversion.of(_pairs(PHRASES) + _pairs(CHARACTERS))
TO_SIMPLIFIED = Conversion.of((t, s) for s, t in _pairs(PHRASES) + _pairs(CHARACTERS))


def variants(query: Column, traditional: Conversion = TO_TRADITIONAL, simplified: Conversion = TO_SIMPLIFIED) -> Column:
    """The query, its traditional and its simplified form, without repeats or empty ones, the query first."""
    forms = F.array(query, traditional.column(query), simplified.column(query))
    return F.array_distinct(F.filter(forms, lambda t: t.isNotNull() & (t != "")))
