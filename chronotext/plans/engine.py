"""The entry API: a session with its models, and the lifecycle from audio or transcripts to documents."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import simplified
from ..operators import jobs, packing, phonetics, quality, sequence, signal, stats, translate
from ..schema import CJK_STYLE, LATIN_STYLE, Style
from ..sources import media, sinks


@dataclass
class Engine:
    """Transcribe, translate and export tables of media. Recogniser and translator are plain functions."""

    spark: SparkSession
    recogniser: media.Recogniser | None = None
    translator: translate.Translator = translate.identity
    style: Style = field(default_factory=lambda: LATIN_STYLE)
    cjk_style: Style = field(default_factory=lambda: CJK_STYLE)
    rebase: bool = True  # put times back by the silence that was cut in front
    dictionary: dict[str, str] | None = None  # English words to ARPAbet
    readings: dict[str, str] | None = None  # Chinese characters to pinyin
    simplified: dict[str, str] | None = None  # traditional to simplified characters

    def transcribe(self, audio: DataFrame, by: list[str], vocals: bool = False) -> DataFrame:
        """Segments of audio rows (by, samples, rate, channel_data if there is any): the signal prepared, speech only, the recogniser, times put back."""
        if self.recogniser is None:
            raise ValueError("an engine without a recogniser cannot transcribe")
        ready = signal.trim_to_speech(signal.prepared(audio, by, vocals=vocals), by)
        found = media.transcribe(ready, by, self.recogniser)
        lead = ready.select(*by, "lead_ms")
        shift = F.col("lead_ms") if self.rebase else F.lit(0.0)
        return found.join(lead, by).withColumns({"start_ms": F.col("start_ms") + shift, "end_ms": F.col("end_ms") + shift}).drop("lead_ms")

    def clean(self, segments: DataFrame, regions: DataFrame, by: list[str], words: DataFrame | None = None, lang: str = "lang") -> DataFrame:
        """Segments (by, seg_no, lang, text, start_ms, end_ms) cleaned by their timed words (by, seg_no, pos, text, start_ms, end_ms)
        and the regions of speech; Chinese ones in their normal form and without spaces."""
        timed = segments.select(*by, "seg_no", F.lit(0).alias("pos"), "text", "start_ms", "end_ms").limit(0) if words is None else words
        told = sequence.normalize_segments(segments, timed, regions, by, "seg_no", "pos").join(segments.select(*by, "seg_no", lang), [*by, "seg_no"])
        chinese = F.coalesce(F.lower(lang).startswith("zh"), F.lit(False))
        plain = F.transform("words", lambda w: w.withField("text", simplified(w["text"], self.simplified)))
        text = F.when(F.col("words").isNotNull(), F.array_join(F.transform(plain, lambda w: w["text"]), "")).otherwise(simplified("text", self.simplified))
        return told.withColumns({"text": F.when(chinese, text).otherwise(F.col("text")), "words": F.when(chinese, plain).otherwise(F.col("words"))})

    def cues(self, segments: DataFrame, by: list[str], lang: str = "lang", clean: bool = True) -> DataFrame:
        """Numbered cues of segments (by, seg_no, lang, text, start_ms, end_ms, words if there are any), without boilerplate and loops.

        A segment with words keeps their times; the time of one without is dealt to the words of its text.
        """
        has_words = F.col("words").isNotNull() & (F.size("words") > 0) if "words" in segments.columns else F.lit(False)
        kept = segments.withColumn("text", F.when(has_words, F.col("text")).otherwise(quality.deloop("text"))).where(~quality.hallucinated("text")) if clean else segments
        columns = [*by, "seg_no", lang, "pos", "text", "start_ms", "end_ms"]
        words = sequence.distribute_words(kept.where(~has_words), [*by, "seg_no", lang], lang=F.col(lang)).select(*columns)
        if "words" in segments.columns:
            own = kept.where(has_words).select(*by, "seg_no", lang, F.posexplode("words").alias("pos", "w"))
            words = words.unionByName(own.select(*by, "seg_no", lang, "pos", F.col("w.text").alias("text"), F.col("w.start_ms").alias("start_ms"), F.col("w.end_ms").alias("end_ms")))
        made = packing.packed_cues(words, by, "seg_no", "pos", lang, self.style, self.cjk_style)
        return sequence.reindex(sequence.fix_overlaps(made, by, ["cue"], self.style.min_gap_ms), by, ["cue"]).drop("cue")

    def annotate(self, cues: DataFrame, lang: str = "lang") -> DataFrame:
        """Cues with `pinyin` where they are Chinese and `ipa` where English or Spanish."""
        code = F.lower(F.coalesce(F.col(lang), F.lit("")))
        said = phonetics.annotate(phonetics.annotate_pinyin(cues, self.readings), lang, self.dictionary) if self.readings else phonetics.annotate(cues, lang, self.dictionary).withColumn("pinyin", F.lit(None).cast("string"))
        return said.withColumns({"pinyin": F.when(code.startswith("zh"), F.col("pinyin")), "ipa": F.when(code.rlike("^(en|es)"), F.col("ipa"))})

    def translate(self, cues: DataFrame, by: list[str], source: str, target: str) -> DataFrame:
        said = translate.translate_cues(cues.withColumn("_text", F.array_join("lines", " ")), by, "index", "_text", source, target, self.translator)
        return translate.translated_cues(cues, said, by, "index", target)

    def check_edits(self, cues: DataFrame, edits: DataFrame, by: list[str]) -> DataFrame:
        """What is wrong with the edits (by, index, text) of each medium, or null: as many as cues, of 1 to 500 characters each."""
        return jobs.edit_check(cues, edits, by)

    def edit(self, cues: DataFrame, edits: DataFrame, by: list[str], lang: str) -> DataFrame:
        """Cues with edited texts (by, index, text) of 1 to 500 characters broken anew; their words are dropped."""
        valid = edits.withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " "))).where(F.char_length("text").between(1, 500))
        said = valid.select(*by, "index", F.col("text").alias("translation"))
        return translate.translated_cues(cues, said, by, "index", lang)

    def documents(self, cues: DataFrame, by: list[str], form: str = "srt", **options) -> DataFrame:
        """One document for each medium: srt, vtt, ass, txt, or json (then with language=, a column of the cues)."""
        forms = {"srt": sinks.srt, "vtt": sinks.vtt, "ass": sinks.ass, "txt": sinks.plain, "json": sinks.study}
        return forms[form](cues, by, **options)

    def statistics(self, cues: DataFrame, by: list[str], media_rows: DataFrame | None = None) -> DataFrame:
        return stats.cue_stats(cues, by, media_rows)
