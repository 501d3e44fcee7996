"""Schemas of the data model."""

from __future__ import annotations

SUBTITLE_FILE = "video_id string, body string"
CUE = "video_id string, cue int, start_ms long, end_ms long, text string"
WINDOW = "video_id string, start_ms long, end_ms long, text string, first_cue int, last_cue int"
TITLE = "id string, name string, kind string, year int, indexed_at long, video_count long, line_count long"
VIDEO = (
    "id string, title_id string, name string, season int, episode int, runtime_ms long, "
    "subtitle_status string, subtitle_note string, audio_index int"
)
LINE = "line_id long, video_id string, title_id string, start_ms long, end_ms long, text string"
LINE_VEC = "line_id long, embedding array<float>, title_id string, video_id string"
MATCH = (
    "line_id long, title_id string, title_name string, video_id string, video_name string, season int, episode int, "
    "start_ms long, end_ms long, text string, score double"
)
STREAM = (
    "struct<index:int,type:string,codec:string,language:string,is_default:boolean,is_forced:boolean,is_text:boolean,is_sdh:boolean>"
)
CATALOGUE_ITEM = (
    f"id string, name string, kind string, year int, provider_ids map<string,string>, runtime_ticks long, "
    f"sources array<struct<id:string,streams:array<{STREAM}>>>"
)
CLIP = (
    "id string, description string, alternates array<struct<line_id:long,title_id:string,video_id:string,start_ms:long,end_ms:long>>, "
    "alternate_index int, pad_before_ms long, pad_after_ms long"
)
