"""Declared schemas; nothing is inferred."""

METADATA = "struct<title:string,component:string,url:string,doc_type:string>"
CHUNK_METADATA = "struct<title:string,component:string,url:string,doc_type:string,headings:array<string>,demo_refs:array<string>,chunk_index:int,split_index:int>"
CITATION = "struct<passage_number:int,chunk_id:string,doc_id:string,score:double,cited_in_text:boolean,source:struct<repo_path:string,corpus_path:string,github_url:string>,demo_refs:array<string>>"

MANIFEST = "flat_name string, url string, doc_type string"
DOCS = f"doc_id string, text string, metadata {METADATA}"
DEMOS = "demo_id string, url string, lang string, code string"
CHUNKS = f"chunk_id string, doc_id string, text string, metadata {CHUNK_METADATA}, token_count int, char_start int, char_end int"
QUESTIONS = "question_id int, question_text string, reference_answer string, gold_chunk_ids array<string>, type string"
ANSWERS = f"answer_id string, question_id int, question_text string, mode string, retriever string, answer_text string, citations array<{CITATION}>"
SEARCH_RESULT = "query_id long, rank int, chunk_id string, score double"
EMBEDDING = "chunk_id string, pos int, embedding array<float>"
REVIEW_FIELDS = ("manual_correctness_0_to_2", "manual_groundedness_0_to_2", "manual_completeness_0_to_2", "manual_notes")
API_PROPS = "struct<name:string,props:map<string,struct<type:struct<name:string,description:string>,default:string,description:string>>>"
