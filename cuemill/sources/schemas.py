"""Schemas of the engine's tables and documents."""

VIDEOS = "ytid string, url string, title string, upload_date date, duration_sec int, channel string, channel_id string, extractor_key string, tags array<string>, categories array<string>, upload_type string, title_date date"
TRANSCRIPTS = "ytid string, kind string, lang string, path string, word_count int, segment_count int"
ASSETS = "ytid string, kind string, path string, bytes bigint"
WORDS = "ytid string, source string, idx int, word string, start_sec decimal(10,3), end_sec decimal(10,3), confidence float, segment_id int"
HITS = "ytid string, start_sec decimal(18,6), end_sec decimal(18,6), label string, source_caption string, source_type string"
STAGE_HITS = "url string, start string, end string, label string, source_caption string, source_type string"
INFO = (
    "id string, webpage_url string, original_url string, title string, upload_date string, duration double, channel string, uploader string, channel_id string, uploader_id string, "
    "extractor_key string, extractor string, tags array<string>, categories array<string>, availability string, live_status string, formats array<struct<acodec:string,format_id:string>>"
)
PROVENANCE = "platform string, id string, url string, title string, uploader string, upload_date string, duration double, base_offset double"
ENTRY = "id string, url string, webpage_url string, ie_key string, extractor_key string, extractor string, title string"
PLAYLIST = f"{ENTRY}, entries array<struct<{', '.join(x.replace(' ', ':', 1) for x in ENTRY.split(', '))}>>"
MANIFEST = "media_file string, segment_idx int, start_time double, end_time double, confidence double, text string"
SEGMENT = "start double, end double, text string, avg_logprob double"
