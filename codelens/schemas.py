"""Schemas of the tables that the library passes between steps."""

DOCUMENTS = "doc_id string, text string, pos long, path string"
INSTANCES = "doc_id string, construct string, ord int, speaker_id string, quote string, quote_index string, confidence int"
#: A row an attempt; what the coder does not report is null.
RESPONSES = "doc_id string, attempt int, response_text string, model string, usage map<string,bigint>, created bigint, response_id string, latency_ms double, raw_response string, error_message string, error_type string, error_output string"
#: A row a document.
METADATA = "doc_id string, model string, usage map<string,bigint>, created bigint, response_id string, latency_ms double, raw_response string, num_retries int, error_message string, error_type string, error_output string"
ERRORS = "doc_id string, document_path string, error_message string, model_used string, ts timestamp"
PROPOSALS = "doc_id string, construct string, ord int, human_index int, llm_index int, paraphrase boolean, match_confidence double"
COMPARISON = (
    "doc_id string, construct string, status string, human_quote string, llm_quote string, human_indices string, llm_indices string, "
    "human_confidence int, llm_confidence int, paraphrase boolean, span_overlap double, match_confidence double, tp int, fp int, fn int"
)
COMPARISON_COLUMNS = [c.split()[0] for c in COMPARISON.split(", ")]
CODEBOOK = "construct string, ord int, definition string, examples array<string>, counter_examples array<string>, extra map<string,string>"
METRICS = ["sensitivity", "precision", "f1", "pabak"]
#: Name of the row over all constructs.
OVERALL = "Overall"
