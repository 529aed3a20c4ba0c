"""The same queries as SQL over the same tables, for an independent engine."""

from __future__ import annotations

PROMPT_SQL = "'USER: ' || chr(10) || 'What is happening in this recording? ASSISTANT: '"

VIDEOS = """
videos as (
  select user_id as video_id, count(*)::bigint as n_frames,
         case user_id % 3 when 0 then 24.0::double when 1 then 25.0::double else 29.97::double end as fps,
         '/in/v_' || user_id || case user_id % 3 when 0 then '.mp4' when 1 then '.avi' else '.MP4' end as path
  from events group by user_id)"""

CUT_VIDEOS = VIDEOS.replace("videos as (", "all_videos as (") + """,
videos as (select video_id, least(n_frames, 20)::bigint as n_frames, 2.0::double as fps, path from all_videos)"""

FRAMES = """
frames as (
  select user_id as video_id, event_type, value as payload, event_id,
         (row_number() over (partition by user_id order by ts, event_id) - 1)::bigint as frame_idx
  from events)"""

CAPTIONS = f"""
captions as (
  select doc_id // 2 as video_id, doc_id % 2 as clip_no, (doc_id % 2) * 30 as start_frame,
         (doc_id % 2) * 30 + 27 as end_frame, {PROMPT_SQL} || text as caption, text as body
  from documents)"""

CAPTION_CATALOG = """
catalog as (
  select distinct doc_id // 2 as video_id,
         case (doc_id // 2) % 3 when 0 then 24.0::double when 1 then 25.0::double else 29.97::double end as fps
  from documents)"""

MESSAGES = """
named as (
  select conv_id, turn, text, '/up/c' || conv_id || '_' || turn || '.mp4' as upload_path,
         (conv_id + turn) % 4 in (0, 2) as single,
         ((conv_id * 7 + turn * 3) % 15 + 0.99)::double as dur,
         (conv_id % 11 <> 0 or (conv_id + turn) % 3 = 0) as convert_ok,
         case when conv_id % 2 = 0 then 'en' else 'it' end as lang
  from conversations where role = 'user'),
judged as (
  select *, case when not single then null when not convert_ok then 'convert_error'
                 when trunc(dur) >= 11 then 'too_long' when trunc(dur) < 2 then 'too_short' else 'ok' end as status
  from named),
gated as (
  select *, case status when 'ok' then upload_path when 'too_long' then replace(upload_path, '.mp4', '_cut.mp4')
                        when 'too_short' then '' when 'convert_error' then '' end as active_set
  from judged),
carried as (
  select *, coalesce(last_value(active_set ignore nulls) over (
              partition by conv_id order by turn rows between unbounded preceding and current row), '') as active_video,
            last_value(case when active_set is not null then turn end ignore nulls) over (
              partition by conv_id order by turn rows between unbounded preceding and current row) as set_turn
  from gated)"""


def timecode(frame: str) -> str:
    t = f"(({frame})::double / fps)"
    return (
        f"printf('%02d:%02d:%02d,%03d', floor({t} / 3600)::bigint, floor(({t} % 3600) / 60)::bigint, "
        f"floor({t} % 60)::bigint, floor((({t} % 60) % 1) * 1000)::bigint)"
    )


def clips(length: int, stride: int) -> str:
    return f"""
sampled as (select *, (n_frames + {stride - 1}) // {stride} as h from videos),
slots as (select *, unnest(range(0, greatest(1, h // {length}))) as clip_no from sampled),
positions as (
  select video_id, clip_no, fps, path, h, i,
         case when h < {length} then (i % h) * {stride} else (clip_no * {length} + i) * {stride} end as frame_idx
  from slots, range({length}) as r(i)),
plan as (
  select video_id, clip_no, any_value(fps) as fps, string_agg(frame_idx::varchar, ',' order by i) as frame_idx,
         min_by(frame_idx, i) as start_frame, max_by(frame_idx, i) as end_frame
  from positions group by video_id, clip_no)"""


def gathered(length: int, where: str = "true") -> str:
    return f"""
found as (
  select video_id, clip_no, count(*)::bigint as n_fetched,
         string_agg(printf('%.2f', payload), ',' order by i) as payload,
         {PROMPT_SQL} || printf('n=%d min=%.3f max=%.3f mean=%.3f', count(*)::bigint,
            min(round(payload * 1000)::bigint) / 1000.0::double, max(round(payload * 1000)::bigint) / 1000.0::double,
            (sum(round(payload * 1000)::bigint)::bigint // count(*)::bigint) / 1000.0::double) as caption
  from positions join frames using (video_id, frame_idx) where {where}
  group by video_id, clip_no),
captioned as (select video_id, clip_no, caption from found where n_fetched = {length})"""


def with_(*parts: str, select: str) -> str:
    return "with " + ", ".join(p.strip() for p in parts) + "\n" + select.strip()


STRIPPED = f"""
stripped as (select video_id, clip_no, replace(caption, {PROMPT_SQL}, '') as text from captions)"""

JOINED = """
joined as (
  select video_id, string_agg(text, ' ' order by clip_no) as text from stripped group by video_id)"""

CHUNKS = """
split as (
  select video_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') as w from joined),
sized as (select *, len(w) as n, (len(w) + 511) // 512 as raw_n from split),
counted as (
  select *, case when raw_n > 1 and n - (raw_n - 1) * 512 < 130 then raw_n - 1 else raw_n end as ne from sized),
numbered as (select *, unnest(range(0, ne)) as chunk_no from counted),
chunks as (
  select video_id, chunk_no,
         case when chunk_no = ne - 1 then n - chunk_no * 512 else 512 end::bigint as n_words,
         array_to_string(list_slice(w, chunk_no * 512 + 1,
             case when chunk_no = ne - 1 then n else (chunk_no + 1) * 512 end), ' ') as chunk
  from numbered)"""


def summary(name: str, source: str, keys: str, text: str, min_input: int = 0) -> str:
    """CTEs ending in ``name(keys, summary)`` for the texts of ``source``."""
    on = " and ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    matches = f"regexp_extract_all({text}, '[^.!?]+[.!?]*')"
    if min_input:
        words = f"len(list_filter(string_split_regex({text}, '\\s+'), lambda x: x <> ''))"
        matches = f"case when {words} < {min_input} then [{text}] else {matches} end"
    return f"""
{name}_m as (select {keys}, {matches} as ms from {source}),
{name}_s as (
  select {keys}, pos, trim(regexp_replace(m, '\\s+', ' ', 'g')) as s
  from (select {keys}, unnest(ms) as m, unnest(range(1, len(ms) + 1)) as pos from {name}_m)),
{name}_n as (select *, len(string_split(s, ' ')) as nw from {name}_s where s <> ''),
{name}_w as (
  select * from (
    select {keys}, pos, unnest(string_split(regexp_replace(lower(s), '[^\\p{{L}}\\p{{N}} ]', '', 'g'), ' ')) as term
    from {name}_n) where term <> ''),
{name}_f as (select {keys}, term, count(*) as tf from {name}_w group by all),
{name}_x as (
  select {keys}, pos, sum(tf)::double / count(*) as score
  from {name}_w join {name}_f using ({keys}, term) group by {keys}, pos),
{name}_r as (
  select a.*, coalesce(b.score, 0.0) as score from {name}_n a left join {name}_x b on {on} and a.pos = b.pos),
{name}_c as (
  select *, sum(nw) over (partition by {keys} order by score desc, pos rows unbounded preceding) as cum from {name}_r),
{name}_k as (
  select {keys}, string_agg(s, ' ' order by pos) as kept from {name}_c
  where cum <= 130 or cum - nw = 0 or cum - nw < 30 group by {keys}),
{name} as (
  select a.*, coalesce(array_to_string(list_slice(string_split(b.kept, ' '), 1, 130), ' '), '') as summary
  from (select {keys} from {source}) a left join (select * from {name}_k) b using ({keys}))"""


HIERARCHICAL = (
    CAPTIONS, STRIPPED, JOINED, CHUNKS,
    summary("level1", "chunks", "video_id, chunk_no", "chunk", 130),
    "rejoined as (select video_id, string_agg(summary, ' ' order by chunk_no) as text from level1 group by video_id)",
    summary("level2", "rejoined", "video_id", "text", 130),
)

LABEL_PROMPTS = """
prompts as (
  select min(vec_id) as prompt_id, 'p' || min(vec_id) as prompt, arg_min(embedding, vec_id)::double[] as v from embeddings group by label),"""
VECTOR_PROMPTS = """
prompts as (select vec_id as prompt_id, 'p' || vec_id as prompt, embedding::double[] as v from embeddings),"""

SCORES = LABEL_PROMPTS + """
clip_vectors as (select vec_id // 5 as video_id, vec_id % 5 as clip_no, embedding::double[] as v from embeddings),
logits as (
  select c.video_id, c.clip_no, p.prompt_id, p.prompt, list_dot_product(c.v, p.v) * 10.0 as z
  from clip_vectors c, prompts p),
shifted as (select *, exp(z - max(z) over (partition by video_id, clip_no)) as e from logits),
scores as (
  select video_id, clip_no, prompt_id, prompt, round(e / sum(e) over (partition by video_id, clip_no), 6) as prob
  from shifted)"""

LAST_SCORES = """
last_scores as (
  select * from scores where clip_no = (select max(clip_no) from clip_vectors c where c.video_id = scores.video_id))"""

REPLIES = (
    CAPTIONS, STRIPPED, JOINED, summary("s", "joined", "video_id", "text"), MESSAGES,
    "video_count as (select count(distinct doc_id // 2) as n from documents)",
    """
answers as (
  select c.*, s.summary,
         case when c.conv_id % 3 <> 0 then 'IT:' || s.summary end as translation,
         case when status is null then 0 when status = 'too_long' then 2 else 1 end as n_verdict
  from carried c cross join video_count v
  left join s on c.active_video <> '' and s.video_id = (c.conv_id * 31 + c.set_turn) % v.n)""",
    """
replies as (
  select conv_id, turn, 0 as pos, text as "user", null as bot from answers
  union all
  select conv_id, turn, 1, active_set, null from answers where status in ('ok', 'too_long')
  union all
  select conv_id, turn, n_verdict, null, case status || lang
      when 'too_longen' then 'This recording is long: only its first 10 seconds are used.'
      when 'too_longit' then 'Registrazione lunga: si usano solo i primi 10 secondi.'
      when 'too_shorten' then 'This recording is under 2 seconds, please send a longer one.'
      when 'too_shortit' then 'La registrazione dura meno di 2 secondi, inviarne una più lunga.'
      when 'convert_erroren' then 'The file could not be converted.'
      when 'convert_errorit' then 'Impossibile convertire il file.' end
  from answers where status in ('too_long', 'too_short', 'convert_error')
  union all
  select conv_id, turn, n_verdict + 1, null,
         case lang when 'en' then 'Send a recording first.' else 'Inviare prima una registrazione.' end
  from answers where active_video = ''
  union all
  select conv_id, turn, n_verdict + 1 + o.pos, null, o.bot
  from (select conv_id, turn, n_verdict, unnest(said) as bot, unnest(range(0, len(said))) as pos from (
    select *, case
        when lang = 'en' then [summary, 'All clip captions are in the file below.', replace(active_video, '.mp4', '.csv')]
        when translation is not null then
          [translation, 'Le didascalie sono nel file qui sotto.', replace(active_video, '.mp4', '.csv')]
        else ['La traduzione non è riuscita.', 'Segue il testo originale:', summary,
              'Le didascalie sono nel file qui sotto.', replace(active_video, '.mp4', '.csv')] end as said
    from answers where active_video <> '')) o)""",
)
REPLIES_SELECT = 'select conv_id, turn, pos::bigint as pos, "user", bot from replies'

SRT_CUES = f"""
cues as (
  select video_id, row_number() over (partition by video_id order by clip_no) as cue_no,
         {timecode("start_frame")} as start_tc, {timecode("end_frame")} as end_tc,
         replace(caption, {PROMPT_SQL}, '') as text
  from captions left join catalog using (video_id))"""

ORACLES = {
    "video_catalog": with_(
        VIDEOS, select="select video_id, path, n_frames, fps, round(n_frames / fps, 6) as duration_s from videos"
    ),
    "frame_numbering": with_(FRAMES, select="select video_id, frame_idx, payload from frames"),
    "clip_index_plan": with_(VIDEOS, clips(5, 3), select="select video_id, clip_no, frame_idx from plan"),
    "clip_index_plan_padded": with_(VIDEOS, clips(8, 8), select="select video_id, clip_no, frame_idx from plan"),
    "stride_sample": with_(FRAMES, select="select video_id, frame_idx, payload from frames where frame_idx % 3 = 0"),
    "clip_spans": with_(VIDEOS, clips(8, 8), select="select video_id, clip_no, start_frame, end_frame from plan"),
    "clip_timecodes": with_(
        VIDEOS, clips(5, 3),
        select=f"select video_id, clip_no, {timecode('start_frame')} as start_tc, {timecode('end_frame')} as end_tc from plan",
    ),
    "clip_frame_gather": with_(
        VIDEOS, FRAMES, clips(8, 8), gathered(8), select="select video_id, clip_no, n_fetched, payload from found"
    ),
    "clip_frame_gather_join": with_(
        VIDEOS, FRAMES, clips(5, 3), gathered(5), select="select video_id, clip_no, n_fetched, payload from found"
    ),
    "full_clip_filter": with_(
        VIDEOS, FRAMES, clips(5, 3), gathered(5, "event_type <> 'error'"),
        select="select video_id, clip_no, payload from found where n_fetched = 5",
    ),
    "head_by_time": with_(
        FRAMES, select="select video_id, frame_idx, payload from frames where frame_idx / 5.0::double < 10"
    ),
    "cut_catalog": with_(
        VIDEOS,
        select="""select video_id, least(n_frames, 50)::bigint as n_frames,
                         round(least(n_frames, 50) / 5.0::double, 6) as duration_s from videos""",
    ),
    "pixel_cast": with_(
        FRAMES,
        select="""select video_id, frame_idx,
                         (trunc(payload)::int & 255)::varchar || ',' || ((event_id % 300)::int & 255)::varchar as px
                  from frames""",
    ),
    "caption_align": with_(
        VIDEOS, FRAMES, clips(5, 3), gathered(5, "event_type <> 'error'"),
        select="""select video_id, clip_no, start_frame, end_frame, caption
                  from plan left join captioned using (video_id, clip_no)""",
    ),
    "caption_sentinel": with_(
        VIDEOS, FRAMES, clips(5, 3), gathered(5, "event_type <> 'error'"),
        select="""select video_id, clip_no, start_frame, end_frame, coalesce(caption, '_') as caption
                  from plan left join captioned using (video_id, clip_no)""",
    ),
    "image_captions": f"""
        select event_id as image_id, 'img_' || event_id as stem,
               {PROMPT_SQL} || printf('n=1 min=%.3f max=%.3f mean=%.3f', round(value * 1000)::bigint / 1000.0::double,
                 round(value * 1000)::bigint / 1000.0::double, round(value * 1000)::bigint / 1000.0::double) as caption
        from events""",
    "incremental_todo": """
        select distinct doc_id // 2 as video_id, '/in/d_' || (doc_id // 2) || '.mp4' as path
        from documents where doc_id // 2 not in (select user_id from events)""",
    "caption_batch": with_(
        VIDEOS, FRAMES, clips(5, 3), gathered(5),
        select="""select video_id, clip_no, start_frame, end_frame, caption
                  from plan left join captioned using (video_id, clip_no)""",
    ),
    "caption_batch_stripped": with_(
        VIDEOS, FRAMES, clips(8, 8), gathered(8),
        select=f"""select video_id, clip_no, start_frame, end_frame, replace(caption, {PROMPT_SQL}, '') as caption
                   from plan left join captioned using (video_id, clip_no)""",
    ),
    "caption_batch_export": with_(
        VIDEOS, FRAMES, clips(5, 3), gathered(5),
        f"""cues as (
          select video_id, path_stem,
                 clip_no + 1 || chr(10) || {timecode("start_frame")} || ' --> ' || {timecode("end_frame")} || chr(10)
                 || replace(caption, {PROMPT_SQL}, '') || chr(10) || chr(10) as cue, clip_no
          from plan join captioned using (video_id, clip_no)
          join (select video_id, replace(replace(path, '/in/', ''), '.mp4', '') as path_stem from videos) using (video_id))""",
        select="""select 'exp' as experiment, 'folder' as video_folder, video_id, path_stem as stem,
                         clip_no + 1 as cue_no, cue as block
                  from cues""",
    ),
    "prompt_strip": with_(CAPTIONS, STRIPPED, select="select video_id, clip_no, text from stripped"),
    "prompt_render": """
        select conv_id, turn, 'USER: ' || chr(10) || replace(text, '<video>', '') || ' ASSISTANT: ' as prompt
        from conversations where role = 'user'""",
    "prompt_struct": """
        select conv_id, turn, '[{"role":"user","content":[{"type":"text","text":' || to_json(text)::varchar
               || '},{"type":"video"}]}]' as prompt
        from conversations where role = 'user'""",
    "caption_join": with_(CAPTIONS, STRIPPED, JOINED, select="select video_id, text from joined"),
    "word_chunks": with_(
        CAPTIONS, STRIPPED, JOINED, CHUNKS, select="select video_id, chunk_no, n_words, chunk from chunks"
    ),
    "document_chunks": with_(
        "joined as (select doc_id as video_id, text from documents)", CHUNKS,
        select="select video_id as doc_id, chunk_no, chunk from chunks",
    ),
    "chunk_route": with_(
        CAPTIONS, STRIPPED, JOINED, CHUNKS,
        select="select video_id, chunk_no, n_words, n_words >= 130 as summarise from chunks",
    ),
    "extractive_summary": with_(summary("s", "documents", "doc_id", "text"), select="select doc_id, summary from s"),
    "hierarchical_summary": with_(
        *HIERARCHICAL, select="select video_id, coalesce(summary, '') as summary from joined left join level2 using (video_id)"
    ),
    "oneshot_summary": with_(
        CAPTIONS, STRIPPED, JOINED, summary("s", "joined", "video_id", "text"), select="select video_id, summary from s"
    ),
    "head_summary": with_(
        CAPTIONS, STRIPPED, JOINED, "heads as (select video_id, substring(text, 1, 4000) as text from joined)",
        summary("s", "heads", "video_id", "text"), select="select video_id, summary from s",
    ),
    "srt_cues": with_(
        CAPTIONS, CAPTION_CATALOG, SRT_CUES, select="select video_id, cue_no, start_tc, end_tc, text from cues"
    ),
    "srt_document": with_(
        CAPTIONS, CAPTION_CATALOG, SRT_CUES,
        select="""select video_id,
                         string_agg(cue_no || chr(10) || start_tc || ' --> ' || end_tc || chr(10) || text || chr(10) || chr(10),
                                    '' order by cue_no) as body
                  from cues group by video_id""",
    ),
    "output_paths": with_(
        VIDEOS,
        select="""select video_id, stem, '/out/csv_captions/exp/folder/output_' || stem || '.csv' as csv_path,
                         '/out/srt_captions/exp/folder/output_' || stem || '.srt' as srt_path,
                         '/out/summary/exp/summary_' || stem || '.csv' as summary_path
                  from (select video_id, replace(replace(path, '/in/', ''), '.mp4', '') as stem from videos)""",
    ),
    "mp4_target": with_(
        VIDEOS,
        select="""select video_id, path, path not like '%.mp4' as needs_convert,
                         '/in/v_' || video_id || '.mp4' as target from videos""",
    ),
    "caption_csv_roundtrip": with_(
        CAPTIONS,
        select="""select 'exp' as experiment, 'folder' as video_folder, video_id, 'd_' || video_id as stem,
                         start_frame, end_frame, caption from captions""",
    ),
    "score_csv_roundtrip": with_(
        SCORES, LAST_SCORES,
        select="""select 'exp' as experiment, 'folder' as video_folder, video_id, 'v_' || video_id as stem, prompt, prob
                  from last_scores""",
    ),
    "summary_csv_roundtrip": with_(
        *HIERARCHICAL,
        select="""select 'exp' as experiment, video_id, 'd_' || video_id as stem, coalesce(summary, '') as summary
                  from joined left join level2 using (video_id)""",
    ),
    "zero_shot_scores": with_(SCORES, select="select video_id, clip_no, prompt_id, prompt, prob from scores"),
    "zero_shot_last_clip": with_(
        SCORES, LAST_SCORES, select="select video_id, clip_no, prompt_id, prompt, prob from last_scores"
    ),
    "upload_gate": with_(
        MESSAGES,
        select="""select conv_id, turn, status, replace(upload_path, '.mp4', '_cut.mp4') as cut_path, active_set
                  from gated where status is not null""",
    ),
    "active_video": with_(MESSAGES, select="select conv_id, turn, active_video from carried"),
    "translate_fallback": """
        select doc_id, 'Translate: ' || text as request, pos::bigint as pos, output from (
          select doc_id, text, unnest(said) as output, unnest(range(0, len(said))) as pos from (
            select doc_id, text, case when doc_id % 3 <> 0 then ['IT:' || text]
              else ['La traduzione non è riuscita.', 'Segue il testo originale:', text] end as said
            from documents))""",
    "chat_replies": with_(*REPLIES, select=REPLIES_SELECT),
    "chat_history": with_(
        *REPLIES,
        select="""select conv_id,
                         string_agg(coalesce("user", '-') || '|' || coalesce(bot, '-'), chr(10) order by turn, pos) as history
                  from replies group by conv_id""",
    ),
}
ORACLES["clip_captions"] = with_(VIDEOS, FRAMES, clips(5, 3), gathered(5), select="select * from captioned")
ORACLES["clip_captions_udf"] = ORACLES["clip_captions"]
ORACLES["clip_frame_members"] = with_(
    VIDEOS, FRAMES, clips(8, 8),
    select="""select distinct video_id, p.clip_no, p.frame_idx, payload
              from positions p join plan using (video_id, clip_no) join frames f using (video_id)
              where f.frame_idx = p.frame_idx and p.frame_idx between start_frame and end_frame""",
)
ORACLES["clip_frame_members_join"] = ORACLES["clip_frame_members"]
ORACLES["zero_shot_scores_blocks"] = ORACLES["zero_shot_scores"]
ORACLES["stream_active_video"] = ORACLES["active_video"]
ORACLES["stream_clips"] = ORACLES["clip_index_plan_padded"]
ORACLES["caption_batch_reuse"] = ORACLES["caption_batch"]
ORACLES["caption_batch_blocks"] = ORACLES["caption_batch"]
ORACLES["caption_stream"] = ORACLES["caption_batch"]
ORACLES["caption_cut_batch"] = ORACLES["caption_batch"].replace(VIDEOS.strip(), CUT_VIDEOS.strip())
ORACLES["hierarchical_summary_udf"] = ORACLES["hierarchical_summary"]
ORACLES["zero_shot_last_clip_many"] = ORACLES["zero_shot_last_clip"].replace(LABEL_PROMPTS.strip(), VECTOR_PROMPTS.strip())
ORACLES["chat_questions"] = with_(
    VIDEOS, FRAMES, clips(5, 3), gathered(5), MESSAGES,
    "user_count as (select count(*) as n from videos)",
    """asked as (
      select c.conv_id, c.turn,
             string_agg('Clip of 5 frames, asked in ' || length('USER: ' || chr(10) || replace(c.text, '<video>', '') || ' ASSISTANT: ')
                        || ' characters.', ' ' order by k.clip_no) as text
      from carried c cross join user_count u join captioned k on k.video_id = (c.conv_id * 31 + c.set_turn) % u.n
      where c.active_video <> '' group by c.conv_id, c.turn)""",
    summary("s", "asked", "conv_id, turn", "text"),
    """answers as (
      select c.*, s.summary,
             case when c.conv_id % 3 <> 0 then 'IT:' || s.summary end as translation,
             case when status is null then 0 when status = 'too_long' then 2 else 1 end as n_verdict
      from carried c left join s on s.conv_id = c.conv_id and s.turn = c.turn)""",
    REPLIES[-1],
    select=REPLIES_SELECT,
)
ORACLES["stream_turns"] = ORACLES["chat_questions"]
ORACLES["stream_history"] = ORACLES["chat_questions"].replace(
    REPLIES_SELECT,
    """select conv_id,
              string_agg(coalesce("user", '-') || '|' || coalesce(bot, '-'), chr(10) order by turn, pos) as history
       from replies group by conv_id""",
)
ORACLES["stream_clips_lossy"] = with_(
    VIDEOS, FRAMES, clips(8, 8),
    select="""select video_id, clip_no, string_agg(frame_idx::varchar, ',' order by i) as frame_idx
              from positions join frames using (video_id, frame_idx) where event_type <> 'error' group by video_id, clip_no""",
)
ORACLES["srt_document_lines"] = ORACLES["srt_document"].replace("|| text ||", "|| replace(text, chr(10), '') ||")
_CELL = """case when {0} = '' then {1} when regexp_matches({0}, '[,"\n\r]') then '"' || replace({0}, '"', '""') || '"' else {0} end"""
ORACLES["output_files"] = with_(
    CAPTIONS, CAPTION_CATALOG, SRT_CUES, STRIPPED, JOINED,
    "heads as (select video_id, substring(text, 1, 4000) as text from joined)", summary("s", "heads", "video_id", "text"),
    f"""whole as (
      select 'csv_captions/exp/folder/output_d_' || video_id || '.csv' as file,
             'Start,End,Caption' || chr(10)
             || string_agg(start_frame || ',' || end_frame || ',' || {_CELL.format("coalesce(caption, '')", "''")} || chr(10), '' order by clip_no) as content
      from captions group by video_id
      union all
      select 'srt_captions/exp/folder/output_d_' || video_id || '.srt',
             string_agg(cue_no || chr(10) || start_tc || ' --> ' || end_tc || chr(10) || text || chr(10) || chr(10), '' order by cue_no)
      from cues group by video_id
      union all
      select 'summary/exp/summary_d_' || video_id || '.csv',
             'Summary' || chr(10) || {_CELL.format("coalesce(summary, '')", "'" + '""' + "'")} || chr(10) from s)""",
    select="select file, octet_length(encode(content))::bigint as length, sha256(content) as digest from whole",
)
ORACLES["translate_errors"] = ORACLES["translate_fallback"].replace(
    "doc_id % 3 <> 0", "length(text) % 3 <> 0"
).replace("'La traduzione non è riuscita.'", "'La traduzione non è riuscita: no answer for ' || length(text) || ' characters'")
ORACLES["zero_shot_top"] = with_(
    SCORES.replace(LABEL_PROMPTS, VECTOR_PROMPTS),
    select="""select video_id, clip_no, row_number() over (partition by video_id, clip_no order by z desc, prompt_id)::bigint as rank,
                     prompt_id, prompt, round(e / sum(e) over (partition by video_id, clip_no), 6) as prob
              from shifted qualify rank <= 3""",
)
_TEXT_PROMPTS = """
prompts as (
  select item_id as prompt_id, text as prompt,
         list_transform(range(64), lambda i: len(list_filter(points, lambda c: c % 64 = i))::double / greatest(1, len(points))) as v
  from (select item_id, text, list_transform(list_filter(string_split(text, ''), lambda c: c <> ''), lambda c: unicode(c)) as points
        from benchmark)),"""
ORACLES["zero_shot_texts"] = with_(
    SCORES.replace(LABEL_PROMPTS, _TEXT_PROMPTS),
    select="""select video_id, clip_no, row_number() over (partition by video_id, clip_no order by z desc, prompt_id)::bigint as rank,
                     prompt_id, prompt, round(e / sum(e) over (partition by video_id, clip_no), 6) as prob
              from shifted qualify rank <= 2""",
)
