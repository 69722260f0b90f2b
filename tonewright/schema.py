"""Table schemas and fixed values of bias annotation."""

from __future__ import annotations

# The labels and scales that results may hold.
LABELS = ("biased", "unbiased")
SEGMENT_SEVERITIES = ("low", "medium", "high")
GLOBAL_SEVERITIES = {"none": 0, "low": 2, "medium": 3, "high": 4}
MAX_CHARS = 5000

SEGMENT = "struct<original:string,replacement:string,severity:string,bias_type:string,reasoning:string,start:int,end:int>"
RESULTS = f"text_id long, binary_label string, severity int, bias_found boolean, biased_segments array<{SEGMENT}>, unbiased_text string, original_text string, repair_strategy string"
REJECTS = "text_id long, raw_output string, stage string, reason string, detail string"
LEXICON = "phrase string, replacement string, severity string, bias_type string, reasoning string"
