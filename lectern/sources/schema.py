"""Schemas of the domain tables, as DDL."""

CANDIDATES = "arxiv_id string, title string, abstract string, authors array<string>, categories array<string>, published_at string, pdf_url string, sections map<string,string>, citation_count int, citation_velocity double"
PAPERS = "id string, arxiv_id string, title string, authors array<string>, abstract string, categories array<string>, published_at string, pdf_url string, citation_count int, score double"
CHUNKS = "id string, paper_id string, section string, chunk_index int, content string, token_count int, embedding array<double>"
EPISODES = "id string, paper_id string, title string, description string, topic string, score double, script string, qa_status string, qa_notes string, duration_secs int, tts_provider string, created_at string"
FEEDBACK = "id string, episode_id string, event_type string, position_secs int, created_at string"
TABLES = {"papers": PAPERS, "chunks": CHUNKS, "episodes": EPISODES, "feedback": FEEDBACK}
STORE = "topics array<string>, " + ", ".join(f"{name} array<struct<{ddl}>>" for name, ddl in TABLES.items()) + ", meta map<string,string>"
ENTRY = "id string, title string, summary string, published string, author array<struct<name:string>>, category array<struct<_term:string>>, link array<struct<_title:string,_href:string>>"
