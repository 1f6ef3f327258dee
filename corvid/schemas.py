"""Schemas of raw files."""

FAQ = "question string, answer string, category string, sub_category string, source string, source_url string, crawled_at string"
AGENT_ANSWER = "question string, answer string, category string, agent_id string, session_id string, created_at string"
DOCUMENT = "title string, category string, content string, sections array<struct<title:string,content:string>>, effective_date string, revision_history array<string>, pdf_url string, source_url string, source string, crawled_at string"
EVAL_CASE = "id string, question string, expected_answer string, category string, difficulty string, expected_sources array<string>"
DATASET = f"version string, generator_model string, generator_provider string, generation_timestamp string, metadata map<string,string>, items array<struct<{EVAL_CASE.replace(' string', ':string').replace(' array', ':array').replace(', ', ',')}>>"
