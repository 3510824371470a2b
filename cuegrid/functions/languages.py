"""Language lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Translation model codes, display names and the voices' supported languages.
NLLB_CODES = {
    "en": "eng_Latn", "it": "ita_Latn", "es": "spa_Latn", "fr": "fra_Latn", "de": "deu_Latn", "pt": "por_Latn",
    "nl": "nld_Latn", "ru": "rus_Cyrl", "zh": "zho_Hans", "ja": "jpn_Jpan", "ko": "kor_Hang", "ar": "arb_Arab",
    "hi": "hin_Deva", "pl": "pol_Latn", "tr": "tur_Latn", "uk": "ukr_Cyrl",
}
DISPLAY_NAMES = {
    "en": "English", "de": "German", "fr": "French", "es": "Spanish", "pl": "Polish", "nl": "Dutch", "hi": "Hindi",
    "it": "Italian", "pt": "Portuguese", "ru": "Russian", "ja": "Japanese", "ko": "Korean",
    "zh": "Chinese (Simplified)", "ar": "Arabic", "tr": "Turkish", "uk": "Ukrainian",
}
VOICES = {
    "chatterbox": ["ar", "da", "de", "el", "en", "es", "fi", "fr", "he", "hi", "it", "ja", "ko", "ms", "nl", "no", "pl", "pt", "ru", "sv", "sw", "tr", "zh"],
    "xtts": ["en", "es", "fr", "de", "it", "pt", "pl", "tr", "ru", "nl", "cs", "ar", "zh", "hu", "ko", "ja", "hi"],
    "openvoice": ["en", "es", "fr", "zh", "ja", "ko"],
}
DEFAULT_TARGETS = ["de", "fr", "es", "pl", "nl", "hi"]


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def display_name(code: Column) -> Column:
    return F.coalesce(_lookup(DISPLAY_NAMES, code), code)


def nllb_code(code: Column, strict: bool = True) -> Column:
    """A known code mapped, one with an underscore as it is; others raise (or are null)."""
    other = F.raise_error(F.concat(F.lit("unsupported language code: "), code)).cast("string") if strict else F.lit(None).cast("string")
    return F.coalesce(_lookup(NLLB_CODES, code), F.when(F.contains(code, F.lit("_")), code).otherwise(other))


def voice_supports(backend: str, code: Column) -> Column:
    return code.isin(*VOICES[backend.lower()])


def checked_voice(backend: str, code: Column) -> Column:
    """The code if the voices support it; else an error that lists the supported codes in order."""
    known = ", ".join(sorted(VOICES[backend.lower()]))
    message = F.concat(F.lit(f"{backend} cannot speak "), F.coalesce(code, F.lit("null")), F.lit(f"; supported: {known}"))
    return F.when(voice_supports(backend, code), code).otherwise(F.raise_error(message).cast("string"))


def voice_error(backend: str, code: Column) -> Column:
    """The message of ``checked_voice`` as a value, null where the voices support the code."""
    known = ", ".join(sorted(VOICES[backend.lower()]))
    message = F.concat(F.lit(f"{backend} cannot speak "), F.coalesce(code, F.lit("null")), F.lit(f"; supported: {known}"))
    return F.when(~F.coalesce(voice_supports(backend, code), F.lit(False)), message)


def resolve_language(detected: Column, requested: Column) -> Column:
    return F.coalesce(F.nullif(detected, F.lit("")), F.nullif(requested, F.lit("")), F.lit("unknown"))
