"""Column names, schemas and fixed character classes."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the behaviour being reproduced).
# ---------------------------------------------------------------------------

# Python's str.split()/str.strip() whitespace: U+0009-000D, U+001C-001F,
# U+0020, U+0085, U+00A0, U+1680, U+2000-200A, U+2028, U+2029, U+202F,
# U+205F, U+3000.  Written as a Java regex character class.
WS_CLASS = (r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
WS_RUN = WS_CLASS + "+"
# The part of it that Java's \s lacks.  ASCII is refused by the first look, and few other texts hold any.
ODD_WS = (r"[[^\x{9}-\x{d}\x{20}-\x{7e}]&&[\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
          r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]")

# Strings pandas' CSV reader turns into missing values by default.
NA_STRINGS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
              "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
              "n/a", "nan", "null")

# Task prefixes in use: training, pipeline/evaluation, inference.
PREFIX_TRAIN = "correct OCR: "
PREFIX_EVAL = "correct: "
PREFIX_INFER = "correct ocr: "

# Byte-token ids: pad, end of sequence, unknown; bytes start at 3.
PAD_ID = 0
EOS_ID = 1
BYTE_OFFSET = 3
LABEL_PAD_ID = -100
MAX_TOKENS = 128

# Segmentation defaults.
DEFAULT_TEXT_DIRECTION = "horizontal-lr"
DEFAULT_SEG_TYPE = "baseline"

# Positional split ratios.
SPLIT_TRAIN = 0.8
SPLIT_VAL = 0.1

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------

REQUIRED_PAIR_COLUMNS = ("ocr_prediction", "text")

PAIR_SCHEMA = T.StructType([
    T.StructField("line_id", T.StringType()),
    T.StructField("image_path", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("ocr_prediction", T.StringType()),
    T.StructField("page_id", T.StringType()),
    T.StructField("line_number", T.StringType()),
])

JSONL_SCHEMA = T.StructType([
    T.StructField("input", T.StringType()),
    T.StructField("target", T.StringType()),
    T.StructField("line_id", T.StringType()),
])

_POINTS = T.ArrayType(T.ArrayType(T.IntegerType()))
SEG_LINE = T.StructType([
    T.StructField("boundary", _POINTS),
    T.StructField("baseline", _POINTS),
    T.StructField("bbox", T.ArrayType(T.IntegerType())),
])
SEGMENTATION_SCHEMA = T.StructType([
    T.StructField("text_direction", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("lines", T.ArrayType(SEG_LINE)),
])

METRIC_LOG_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("cer", T.DoubleType()),
    T.StructField("bleu", T.DoubleType()),
    T.StructField("edit_distance", T.DoubleType()),
    T.StructField("eval_samples", T.LongType()),
])

ROW_SCORE_COLUMNS = ("sample_id", "ocr_input", "prediction", "ground_truth", "edit_distance",
                     "bleu_score", "input_length", "output_length", "target_length",
                     "ocr_errors", "improvement")
