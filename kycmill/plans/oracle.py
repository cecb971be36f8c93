"""The registered queries in SQL, for comparison. Written from the meaning, not from the Spark plans."""

from __future__ import annotations

import re

VIEWS = {
    "v_tenants": """
select n_nationkey as tenant_id, n_name as name, lower(n_name) as slug,
  case when n_nationkey=24 then 'trial' else ['standard','pro','enterprise'][n_regionkey%3+1] end as plan_tier,
  case when n_nationkey%12=11 then 'suspended' else 'active' end as status from nation""",
    "v_cases": """
select *, case when status in ('approved','rejected') then status end as decision,
  case when status<>'pending' then round((case_id%1001)/1000.0,3) end as risk_score,
  case when status in ('approved','rejected') then created_at + interval 1 day end as decided_at
from (select o_orderkey as case_id, c_nationkey as tenant_id, c_name as subject_name,
  date '1950-01-01' + (c_custkey%18000)::int as subject_dob,
  case when o_orderstatus='F' and o_orderkey%5=0 then 'rejected' when o_orderstatus='F' then 'approved'
       when o_orderstatus='P' then 'needs_review' else 'pending' end as status,
  o_orderdate as created_at,
  case when o_orderkey%3<>0 then case when o_custkey%200=0 then '' else (o_custkey%200)::varchar end end as idempotency_key
from orders join customer on o_custkey=c_custkey)""",
    "v_evidence": """
select l_orderkey as case_id, concat_ws('-',l_linenumber,l_partkey,l_suppkey) as evidence_id,
  round(1-l_discount,3) as confidence, case when l_linenumber<>7 then round(1-l_tax*4,3) end as face,
  case when l_quantity>=49 then 1 else 0 end as hits, l_shipdate as created_at, l_linestatus from lineitem""",
    "v_latest": """
select * from (select *, row_number() over (partition by case_id order by created_at desc, evidence_id desc) as rn
from v_evidence) where rn=1""",
    "v_documents": """
select tenant_id, case_id, 'id_document' as doc_type, case_id||'-id_document-0' as document_id,
  tenant_id||'/'||case_id||'/id_document' as s3_key, created_at as uploaded_at from v_cases where case_id%50<>7
union all select tenant_id, case_id, 'id_document', case_id||'-id_document-1',
  tenant_id||'/'||case_id||'/id_document/v2', created_at + interval 1 hour from v_cases where case_id%25=0
union all select tenant_id, case_id, 'selfie', case_id||'-selfie-0',
  tenant_id||'/'||case_id||'/selfie', created_at from v_cases where case_id%40<>3""",
    "v_step_names": """
select * from (values ('fetch_case_documents',0,97,null),('extract_document',1,89,'mrz-icao9303'),
  ('face_match',2,83,'insightface-buffalo_l'),('sanctions_screen',3,79,null),('update_case_status',4,null,null),
  ('risk_score',5,null,null),('finalize_case',6,null,null),('deliver_webhooks',7,null,null))
  t(step,seq,bad,model_version)""",
    "v_steps": """
select tenant_id, case_id, step, seq, model_version,
  case when bad is not null and case_id%bad=0 then 'failed'
       when not (step='sanctions_screen' and case_id%71=0) then 'completed' end as outcome,
  case when model_version is not null then sha256(case_id::varchar) end as input_hash,
  '{"case_id": "'||case_id||'"}' as payload, 'step "'||step||'" '||repeat('x',600) as error,
  created_at + to_minutes(seq) as "at"
from v_cases cross join v_step_names""",
    "v_decisions": """
select d.*, (coalesce(c.tenant_id,0)+case when decision_id%13=5 then 1 else 0 end)%25 as tenant_id from (
select event_id as decision_id, user_id as reviewer_id,
  case when event_id%101=0 then -event_id else event_id%(select count(*)//5 from orders) end as case_id,
  case event_type when 'purchase' then 'approved' when 'error' then 'rejected' else 'escalated' end as decision,
  props as justification, ts as decided_at from events) d left join v_cases c on c.case_id=d.case_id""",
    "v_mutations": """
select event_id%(select count(*)//5 from orders) as case_id, event_id as seq,
  case event_type when 'purchase' then 'approved' when 'error' then 'rejected' when 'view' then 'needs_review' end as status,
  case when event_type='click' then round((event_id%1000)/1000.0,3) end as risk_score,
  case event_type when 'purchase' then 'approved' when 'error' then 'rejected' end as decision,
  case when event_type in ('purchase','error') then ts end as decided_at from events""",
    "v_reviewers": """
select s_suppkey as reviewer_id, s_nationkey as tenant_id, 'r'||(s_suppkey%40)||'@example.com' as email,
  case when s_suppkey%17=0 then 'owner' else ['reviewer','admin','auditor'][s_suppkey%3+1] end as role,
  timestamp '2023-01-01' + to_days((s_suppkey%700)::int) as created_at, sha256(s_name) as token_hash,
  case when s_acctbal<0 then timestamp '2024-01-01' end as revoked_at from supplier""",
    "v_api_keys": """
select c_custkey as api_key_id, c_nationkey as tenant_id, sha256(c_name) as key_hash,
  case when c_acctbal<0 then timestamp '2024-01-01' end as revoked_at from customer""",
    "v_webhooks": """
select s_suppkey as webhook_id, s_nationkey as tenant_id,
  case when s_acctbal<0 then timestamp '2024-01-01' end as disabled_at from supplier""",
    "v_deliveries": """
select concat_ws('-',l_orderkey,l_linenumber,l_partkey,l_suppkey) as delivery_id, l_suppkey as webhook_id,
  l_orderkey as case_id, case l_returnflag when 'R' then 'failed' when 'A' then 'delivered' else 'pending' end as status,
  1+l_linenumber%3 as attempt_count,
  case when not (l_linestatus='O' and l_linenumber%2=0) then l_shipdate end as last_attempted_at from lineitem""",
    "v_delivery_attempts": """
select l_orderkey as case_id, l_suppkey%2 as webhook_id, l_linenumber as attempt, l_returnflag='A' as ok from lineitem""",
    "v_outcomes": """
select case_id, webhook_id,
  case when won is not null then 'delivered' when used>=3 then 'failed' else 'pending' end as status,
  coalesce(won,used)::int as attempt_count
from (select case_id, webhook_id, min(attempt) filter (ok) as won, max(attempt) as used
      from v_delivery_attempts where attempt<=3 group by all)""",
    "v_audit": """
select event_id as id, user_id%25 as tenant_id, event_id%97 as case_id, event_type, 'user:'||user_id as actor,
  case when event_type='view' then 'm1' end as model_version, props as payload, ts as created_at from events""",
    "v_audit_text": """
select *, row_number() over (partition by tenant_id order by id) as rn,
  concat_ws(chr(30), tenant_id, case_id, event_type, actor, coalesce(model_version,''), '', payload,
    strftime(created_at,'%Y-%m-%dT%H:%M:%S') || case when microsecond(created_at)%1000000=0 then ''
      else '.'||strftime(created_at,'%f') end || '+00:00', '') as prefix from v_audit""",
    "v_chain": """
select id, tenant_id, rn, null::varchar as prev_row_hash, sha256(prefix) as row_hash from v_audit_text where rn=1
union all
select a.id, a.tenant_id, a.rn, c.row_hash, sha256(a.prefix||c.row_hash)
from v_chain c join v_audit_text a on a.tenant_id=c.tenant_id and a.rn=c.rn+1""",
    "v_tampered": """
select id, tenant_id, prev_row_hash, case when id%500<>7 then row_hash end as row_hash, id%500 in (3,7) as altered
from v_chain where id%700<>5""",
    "v_verified": """
select tenant_id, id, concat_ws(',',
  case when prev_row_hash is distinct from lag(row_hash) over (partition by tenant_id order by id)
    then 'prev_row_hash' end, case when altered then 'row_hash' end) as violations
from v_tampered""",
    "v_step_audit": """
select id, tenant_id, case_id, created_at,
  ['fetch_case_documents','extract_document','face_match','sanctions_screen','update_case_status',
   'risk_score','finalize_case','deliver_webhooks'][(id%97)%8+1] as step,
  case event_type when 'purchase' then 'completed' when 'error' then 'failed' else 'started' end as phase from v_audit""",
    "v_paired": """
select *, lead(phase) over w as next_phase, lead(created_at) over w as next_at from v_step_audit
window w as (partition by tenant_id, case_id, step order by id)""",
    "v_quota": """
select user_id as key, event_id as request_id, ts, epoch_us(ts) as t,
  row_number() over (partition by user_id order by ts, event_id) as rn from events""",
    "v_quota_fold": """
select key, request_id, t, rn, t as anchor, 1 as used, true as allowed from v_quota where rn=1
union all
select q.key, q.request_id, q.t, q.rn, case when q.t-f.anchor>=86400000000 then q.t else f.anchor end,
  case when q.t-f.anchor>=86400000000 then 1 when f.used<2 then f.used+1 else f.used end,
  q.t-f.anchor>=86400000000 or f.used<2
from v_quota_fold f join v_quota q on q.key=f.key and q.rn=f.rn+1""",
    "v_quota_result": """
select key, request_id, allowed,
  case when allowed then 0 else (floor((86400000000-(t-anchor))/1000000)+1)::int end as retry_after from v_quota_fold""",
    "v_tokens": """
select event_id as request_id, case when kind=1 then 'Basic abc' when kind=2 then 'Bearer  '
  when kind between 3 and 5 then 'Bearer Supplier#'||lpad(user_id::varchar,9,'0')
  when kind between 6 and 8 then 'Bearer Customer#'||lpad(user_id::varchar,9,'0')
  when kind=9 then 'Bearer nobody' end as header
from (select *, event_id%10 as kind from events)""",
    "v_attempts": """
select conv_id as document_id, ((turn+1)//2)::int as attempt, case when (conv_id*3+turn)%7=5 and conv_id%11=3 then 7
  when (conv_id*3+turn)%7=5 and conv_id%11=5 then 8 else (conv_id*3+turn)%7 end as kind, length(text) as n
from conversations where role='assistant'""",
    "v_responses": """
select document_id, min(attempt) filter (kind in (5,6) and attempt<=3) as good, max(attempt) filter (attempt<=3) as tried,
  arg_min(kind, attempt) filter (kind in (5,6) and attempt<=3) as good_kind,
  arg_min(n, attempt) filter (kind in (5,6) and attempt<=3) as n,
  arg_max(['not valid JSON','no document visible','no document visible','full_name empty','date_of_birth invalid','','',
    'not valid JSON','nationality not a text'][kind+1],
    attempt) filter (kind not in (5,6) and attempt<=3) as issue
from v_attempts where attempt<=3 group by 1""",
    "v_resolved": """
select document_id,
  case good_kind when 5 then 'ANNA MARIA' when 6 then 'JON DOE' end as full_name,
  case when good is not null then 'D'||n end as document_number,
  case good_kind when 5 then '1980-01-02' when 6 then '1990-12-31' end as date_of_birth,
  case good_kind when 6 then '2031-05-06' end as expiry_date,
  case when good is null then 0.0::double else greatest(0.5, 1.0::double-0.15::double*(good-1)) end as confidence,
  good is null as needs_review,
  case when good is null then 'exhausted 3 retries; last issue: '||issue end as reason
from v_responses where good is not null or tried>=3""",
    "v_mrz_parts": """
select c_custkey as document_id, c_mktsegment as seg, lpad(c_custkey::varchar,9,'0') as num,
  lpad((c_custkey%100)::varchar,2,'0')||case when c_custkey%11=0 then '13' else lpad((c_custkey%12+1)::varchar,2,'0') end
    ||lpad((c_custkey%28+1)::varchar,2,'0') as dob, '3'||(c_custkey%10)::varchar||'0101' as exp from customer""",
    "v_mrz": """
select document_id, rpad('P<UTO'||upper(seg)||'<<ANNA<MARIA',44,'<') as line1,
  case when document_id%13=0 then left(z,40) when document_id%7=0 then 'Z'||substr(z,2) else z end as line2
from (select *, n1||'UTO'||d1||'F'||e1||repeat('<',15)||{CD(n1||d1||e1)} as z
from (select *, num||{CD(num)} as n1, dob||{CD(dob)} as d1, exp||{CD(exp)} as e1 from v_mrz_parts))""",
    "v_mrz_checked": """
select document_id, length(line2)=44 as whole,
  array_to_string(list_filter([
    case when {CD(substr(line2,1,9))}<>{VAL(line2[10])} then 'document_number' end,
    case when {CD(substr(line2,14,6))}<>{VAL(line2[20])} then 'date_of_birth' end,
    case when {CD(substr(line2,22,6))}<>{VAL(line2[28])} then 'expiry_date' end,
    case when line2[43]<>'<' and {CD(substr(line2,29,14))}<>{VAL(line2[43])} then 'personal_number' end,
    case when {CD(substr(line2,1,10)||substr(line2,14,7)||substr(line2,22,7)||substr(line2,29,15))}<>{VAL(line2[44])}
      then 'composite' end,
    case when birth is null then 'date_of_birth_format' end,
    case when expiry is null then 'expiry_date_format' end], lambda x: x is not null), ',') as failed,
  birth, expiry, line1, line2
from (select *, try_cast(case when substr(line2,14,2)>'24' then '19' else '20' end||substr(line2,14,2)||'-'||
    substr(line2,16,2)||'-'||substr(line2,18,2) as date) as birth,
  try_cast('20'||substr(line2,22,2)||'-'||substr(line2,24,2)||'-'||substr(line2,26,2) as date) as expiry from v_mrz)""",
    "v_mrz_result": """
select document_id,
  case when whole then 'ANNA MARIA '||rtrim(split_part(substr(line1,6,39),'<<',1),'<') end as full_name,
  case when whole then rtrim(substr(line2,1,9),'<') end as document_number,
  case when whole then rtrim(substr(line2,11,3),'<') end as nationality,
  case when whole then birth end as date_of_birth, case when whole then expiry end as expiry_date,
  case when whole then 'P' end as document_type,
  case when whole then failed else 'line_length' end as failed_checks, whole and failed='' as valid
from v_mrz_checked""",
    "v_subjects": """
select vec_id as query_id, p_name as name, embedding::double[] as vector, label
from embeddings join part on p_partkey=vec_id%(select count(*) from part)""",
    "v_watchlist": """
select {UUID5(list_source||':'||name)} as entry_id, *
from (select *, row_number() over (partition by list_source, name order by version desc) as rn
  from (select 'LIST-'||(query_id%1000) as list_source, name, vector, query_id as version from v_subjects))
where rn=1""",
    "v_vector_hits": """
select query_id, entry_id, list_source, name, score from (
  select *, row_number() over (partition by query_id order by score desc, entry_id) as k
  from (select q.query_id, w.entry_id, w.list_source, w.name, list_inner_product(q.vector, w.vector) as score
        from v_subjects q cross join v_watchlist w) where score>=0.25) where k<=5""",
    "v_words": """
select * from (values ('blue','PL','PL'),('cold','KLT','KLT'),('hot','HT','HT'),('large','LRJ','LRK'),('new','N','N'),
  ('old','ALT','ALT'),('red','RT','RT'),('small','SML','XML'),
  ('anvil','NFL','NFL'),('bolt','PLT','PLT'),('gear','JR','KR'),('gizmo','JSM','KSM'),('plate','PLT','PLT'),
  ('ring','RNK','RNK'),('rod','RT','RT'),('widget','JT','JT')) t(word,first,second)""",
    "v_codes": """
select name, first, case when second<>first then second else '' end as second from (
  select name, a.first||b.first as first,
    case when name='new gizmo' then 'NKTSM' else a.second||b.second end as second
  from (select distinct p_name as name from part) n
  join v_words a on a.word=split_part(n.name,' ',1) join v_words b on b.word=split_part(n.name,' ',2))""",
    "v_code_rows": """
select name, first as code from v_codes union all select name, second from v_codes where second<>''""",
    "v_part_list": """
select {UUID5(list_source||':'||name)} as entry_id, * from (
  select p_brand as list_source, p_name as name, max(p_partkey) as version from part group by all)""",
    "v_phonetic_hits": """
select query_id, entry_id, list_source, name from (
  select *, row_number() over (partition by query_id order by entry_id) as k from (
    select distinct q.query_id, w.entry_id, w.list_source, w.name
    from v_subjects q join v_code_rows a on a.name=q.name join v_code_rows b on b.code=a.code
    join v_watchlist w on w.name=b.name)) where k<=10""",
    "v_screened": """
select query_id, list_source, name as matched_name, score as match_score, 'vector' as method from v_vector_hits
union all select query_id, list_source, name, 1.0, 'phonetic' from v_phonetic_hits p
where not exists (select 1 from v_vector_hits v where v.query_id=p.query_id and v.list_source=p.list_source and v.name=p.name)""",
    "v_risk": """
select *, case when hits>0 or face is null then 1.0 else round(1-(0.6::double*face+0.4::double*confidence),4) end as risk_score,
  hits>0 or face is null or 0.6::double*face+0.4::double*confidence<0.85 as needs_review,
  case when hits>0 then 'sanctions list hit' when face is null then 'no face detected for comparison'
    when 0.6::double*face+0.4::double*confidence<0.85 then 'combined confidence '||
      printf('%.4f',0.6::double*face+0.4::double*confidence)||' below auto-clear threshold 0.85' end as risk_reason""",
    "v_decided": """
select tenant_id, case_id, case when parked then 'needs_review' else 'approved' end as status,
  case when fetch_failed then 'failed to fetch case documents' when no_id then 'no id_document found for case'
    when no_extraction then 'extraction failed or timed out'
    when unsure then 'exhausted 3 retries; last issue: no document visible'
    when no_selfie then 'no selfie found for case' when face_failed then 'face match activity failed'
    when screen_failed then 'sanctions screening activity failed' else risk_reason end as reason,
  case when reached then confidence end as confidence, case when reached then method end as method,
  case when scored and not face_failed then face end as face_match_score,
  case when scored and not screen_failed then hits end as sanctions_hit_count,
  case when scored then risk_score end as risk_score
from (select *, not scored or face_failed or screen_failed or needs_review as parked from (
  select *, {RISK} from (
    select *, reached and not unsure and not no_selfie as scored,
      case when not face_failed then raw_face end as face, case when not screen_failed then raw_hits else 0 end as hits
    from (select *, not (fetch_failed or no_id or no_extraction) as reached from (
      select c.tenant_id, c.case_id, c.case_id%97=0 as fetch_failed,
        c.case_id%50=7 and c.case_id%25<>0 as no_id, c.case_id%89=0 or e.case_id is null as no_extraction,
        coalesce(e.confidence<0.905,false) as unsure, c.case_id%40=3 as no_selfie,
        c.case_id%83=0 or e.case_id is null as face_failed, c.case_id%79=0 or e.case_id is null as screen_failed,
        case when e.confidence<0.905 then 0.0 else e.confidence end as confidence,
        case when e.l_linestatus='O' then 'mrz' else 'vlm' end as method, e.face as raw_face, e.hits as raw_hits
      from v_cases c left join v_latest e on e.case_id=c.case_id)))))""",
    "v_final": """
select tenant_id, case_id, arg_min(decision, (decided_at, decision_id)) filter (decision<>'escalated') as decision,
  arg_min(reviewer_id, (decided_at, decision_id)) filter (decision<>'escalated') as reviewer_id,
  arg_min(decided_at, (decided_at, decision_id)) filter (decision<>'escalated') as decided_at,
  count(*) filter (decision='escalated') as escalations from v_decisions group by 1, 2""",
    "v_resolution": """
select d.tenant_id, d.case_id, case when status='needs_review' then coalesce(f.decision,status) else status end as final_status,
  reason, risk_score, case when status='needs_review' then f.reviewer_id end as reviewer_id,
  case when status='needs_review' then f.decided_at end as decided_at,
  case when status='needs_review' then coalesce(f.escalations,0) end as escalations
from v_decided d left join v_final f on f.case_id=d.case_id and f.tenant_id=d.tenant_id""",
    "v_counts": """
select t.tenant_id, s.status, count(c.case_id) as n from v_tenants t
cross join (select unnest(['pending','processing','needs_review','approved','rejected']) as status) s
left join v_cases c on c.tenant_id=t.tenant_id and c.status=s.status group by all""",
}
_RISK = VIEWS.pop("v_risk").split("select *,", 1)[1]

# Weighted digit sum and character value of the passport standard; URL-namespace UUID version 5.
_VAL = "greatest(instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ',{c})-1,0)"
_CD = "(list_sum(list_transform(range(1,length({s})+1), lambda i: " + _VAL.format(c="({s})[i]") + "*[7,3,1][(i-1)%3+1]))%10)"
# Key block of a message authentication code: a short secret, padded to 64 bytes, against one byte.
_PAD = (
    "array_to_string(list_transform(range(1,65), lambda i: "
    "printf('%02x', xor(case when i<=length(secret) then ascii(secret[i]) else 0 end, {x}))), '')"
)
_UUID5 = (
    "(select substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'||translate(substr(h,17,1),'0123456789abcdef',"
    "'89ab89ab89ab89ab')||substr(h,18,3)||'-'||substr(h,21,12) from (select "
    "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8')||encode({s})) as h))"
)


def _macro(text: str, name: str, template: str, key: str) -> str:
    def replace(m: re.Match) -> str:
        return template.replace("{" + key + "}", m.group(1))

    return re.sub(r"\{" + name + r"\((.*?)\)\}", replace, text, flags=re.S)


def expand(text: str) -> str:
    text = text.replace("{RISK}", _RISK)
    text = _macro(text, "CD", _CD, "s")
    text = _macro(text, "VAL", _VAL, "c")
    return _macro(text, "UUID5", _UUID5, "s")


def _needed(text: str, found: list[str], open_: tuple[str, ...] = ()) -> list[str]:
    for name in re.findall(r"\bv_\w+", text):
        if name in VIEWS and name not in found and name not in open_:
            _needed(VIEWS[name], found, (*open_, name))
            found.append(name)
    return found


def with_views(body: str) -> str:
    """``body`` preceded by every view it uses, in order of use."""
    names = _needed(body, [])
    ctes = ",\n".join(f"{n} as ({expand(VIEWS[n])})" for n in names)
    return f"with recursive {ctes}\n{expand(body)}" if names else expand(body)


_STEP_EVENTS = """
select tenant_id, case_id, step||'.started' as event_type, 'system:pipeline-worker' as actor, null as model_version,
  null as input_hash, '{}' as payload, seq*2+2 as seq, v_steps.at as created_at from v_steps
union all
select tenant_id, case_id, step||'.'||outcome, 'system:pipeline-worker', case when outcome='completed' then model_version end,
  case when outcome='completed' then input_hash end,
  case when outcome='failed' then '{"error": "'||replace(substr(error,1,500),'"','\\"')||'"}' else payload end,
  seq*2+3, v_steps.at from v_steps where outcome is not null
union all
select c.tenant_id, case_id, 'case_created', 'api-key:'||(case_id%1500), null, null,
  '{"plan_tier": "'||plan_tier||'", "subject_name": "'||subject_name||'"}', 0, created_at
from v_cases c join v_tenants t on t.tenant_id=c.tenant_id where case_id%3<>1
union all
select c.tenant_id, d.case_id, 'review_decision_recorded', 'reviewer:'||reviewer_id, null, null,
  '{"decision": "'||d.decision||'", "justification": "'||replace(justification,'"','\\"')||'"}', 18, d.decided_at
from v_decisions d join v_cases c on c.case_id=d.case_id"""

BODIES = {
    "tenant_scope": "select case_id, tenant_id, status from v_cases where tenant_id=3",
    "list_cases": """select case_id, status, subject_name, subject_dob, decision, created_at, risk_score from v_cases
where tenant_id=3 and status='approved' order by created_at desc, case_id desc limit 200""",
    "review_queue": """select case_id, subject_name, subject_dob, risk_score, created_at from v_cases
where tenant_id=3 and status='needs_review'""",
    "domain_quarantine": """select table_name, failed_rules, count(*) as n, min(row_id) as first_row from (
  select 'tenants' as table_name, tenant_id::varchar as row_id,
    case when plan_tier not in ('standard','pro','enterprise') then 'plan_tier_domain' else '' end as failed_rules from v_tenants
  union all select 'cases', case_id::varchar, '' from v_cases
  union all select 'reviewers', reviewer_id::varchar, case when role not in ('reviewer','admin','auditor') then 'role_domain' else '' end
    from v_reviewers
  union all select 'review_decisions', decision_id::varchar, '' from v_decisions
  union all select 'sanctions_hits', l_orderkey::varchar, '' from lineitem where l_quantity>=49
  union all select 'webhook_deliveries', delivery_id, '' from v_deliveries) group by 1, 2""",
    "upload_validation": """select doc_id, content_type, size_bytes, case
  when content_type='text/plain' then 'content_type must be one of [''application/pdf'', ''image/jpeg'', ''image/png'']'
  when size_bytes<=0 then 'size_bytes must be positive'
  when size_bytes>10485760 then 'size_bytes exceeds the 10485760-byte limit' end as error
from (select doc_id, ['image/jpeg','image/png','application/pdf','text/plain'][doc_id%4+1] as content_type,
  case when doc_id%5=0 then 0 else n_chars*1000 end as size_bytes from documents)""",
    "id_format": "select doc_id, doc_id%4<>3 as is_valid from documents",
    "webhook_url_check": "select page_id, url, starts_with(url,'https://') as ok from pages",
    "risk_bands": """select case_id, risk_score, case when risk_score is null then 'unscored' when risk_score<=0.15 then 'low'
  when risk_score<=0.5 then 'medium' else 'high' end as band from v_cases""",
    "lane_routing": """select c.tenant_id, case_id, c.tenant_id||'/'||case_id||'/id_document' as id_document_key,
  c.tenant_id||'/'||case_id||'/selfie' as selfie_key, 'kyc-case-'||case_id as run_id,
  case when plan_tier<>'trial' then 'kyc-case-'||plan_tier end as lane,
  case when plan_tier='trial' then 'unknown plan_tier' end as lane_error
from v_cases c join v_tenants t on t.tenant_id=c.tenant_id""",
    "case_lookup": """select case_id, status from v_cases where tenant_id=3 and case_id in (select event_id from events)""",
    "case_detail": """
with_e as (select *, row_number() over (partition by l_orderkey order by l_shipdate desc,
  concat_ws('-',l_linenumber,l_partkey,l_suppkey) desc) as rn from lineitem),
with_f as (select *, row_number() over (partition by l_orderkey order by l_shipdate desc,
  concat_ws('-',l_linenumber,l_partkey,l_suppkey) desc) as rn from lineitem where l_quantity>10),
with_h as (select l_orderkey, count(*) as n, max(round(l_quantity/50,3)) as top,
  string_agg('LIST-'||l_returnflag||'|Part '||l_partkey||'|'||case when l_linestatus='F' then 'vector' else 'phonetic' end, ';'
    order by l_returnflag, 'Part '||l_partkey, l_quantity, l_linestatus desc) as hits
  from lineitem where l_quantity>=49 group by 1)
select c.tenant_id, c.case_id, c.status, c.subject_name, c.subject_dob, c.decision, c.created_at, c.risk_score,
  case when c.case_id%25=0 then c.tenant_id||'/'||c.case_id||'/id_document/v2'
    when c.case_id%50<>7 then c.tenant_id||'/'||c.case_id||'/id_document' end as id_document_key,
  case when c.case_id%40<>3 then c.tenant_id||'/'||c.case_id||'/selfie' end as selfie_key,
  concat_ws('-',e.l_linenumber,e.l_partkey,e.l_suppkey) as extraction_id_raw,
  e.l_orderkey||'-id_document-0' as document_id, coalesce(h.hits,'') as sanctions_hits,
  case when e.l_linestatus='O' then 'mrz' when e.l_orderkey is not null then 'vlm' end as method,
  round(1-e.l_discount,3) as confidence, e.l_returnflag<>'R' as valid,
  case when e.l_returnflag<>'R' then 'P'||e.l_partkey end as full_name, null::varchar as date_of_birth,
  case when e.l_returnflag<>'R' then e.l_suppkey::varchar end as document_number,
  case when e.l_returnflag<>'R' then 'UTO' end as nationality, null::varchar as expiry_date,
  f.l_orderkey is not null as has_face_match, case when f.l_linenumber<>7 then round(1-f.l_tax*4,3) end as similarity_score,
  case when f.l_linenumber=7 then 'No face detected in one or both images' end as face_reason,
  coalesce(h.n,0) as hit_count, h.top as highest_score
from v_cases c left join with_e e on e.l_orderkey=c.case_id and e.rn=1
left join with_f f on f.l_orderkey=c.case_id and f.rn=1 left join with_h h on h.l_orderkey=c.case_id""",
    "case_hits": """select tenant_id, case_id, 'LIST-'||l_returnflag as list_source, 'Part '||l_partkey as matched_name,
  round(l_quantity/50,3) as match_score, case when l_linestatus='F' then 'vector' else 'phonetic' end as method
from lineitem join v_cases on case_id=l_orderkey where l_quantity>=49""",
    "webhook_outbox": f"""select tenant_id, webhook_id, case_id, event_type, body,
  sha256(unhex({_PAD.format(x=92)}||sha256(unhex({_PAD.format(x=54)}||hex(encode(body)))))) as signature
from (select c.tenant_id, webhook_id, case_id, 'case.decided' as event_type, 'secret-'||webhook_id as secret,
  '{{"case_id": "'||case_id||'", "decision": "'||decision||'", "event": "case.decided", "risk_score": '||risk_score||'}}' as body
from v_cases c join v_webhooks w on w.tenant_id=c.tenant_id where decision is not null and disabled_at is null)""",
    "delivery_outcome": "select * from v_outcomes",
    "delivery_summary": """select c.case_id, count(*) filter (o.status='delivered') as delivered_count,
  count(*) filter (o.status='failed') as failed_count, count(o.case_id) as webhooks_count
from v_cases c left join v_outcomes o on o.case_id=c.case_id group by 1""",
    "delivery_log": """select delivery_id, webhook_id, case_id, status, attempt_count, last_attempted_at from v_deliveries
where webhook_id in (select webhook_id from v_webhooks where tenant_id=3)""",
    "vector_screen": "select query_id, entry_id, round(score,6) as score from v_vector_hits",
    "phonetic_codes": "select p_partkey as query_id, name, concat_ws(',',first,nullif(second,'')) as codes from part join v_codes on name=p_name",
    "embed_names": "select p_partkey as query_id, p_name as name, 16 as dimension, 1.0::double as norm from part",
    "phonetic_screen": """select query_id, entry_id from (
  select *, row_number() over (partition by query_id order by entry_id) as k from (
    select distinct p.p_partkey as query_id, w.entry_id from part p join v_code_rows a on a.name=p.p_name
    join v_code_rows b on b.code=a.code join v_part_list w on w.name=b.name)) where k<=10""",
    "screen_names": "select query_id, list_source, matched_name, round(match_score,6) as match_score, method from v_screened",
    "screen_summary": """select q.query_id, count(s.query_id) as hit_count, round(max(match_score),6) as highest_score
from v_subjects q left join v_screened s on s.query_id=q.query_id group by 1""",
    "watchlist_ingest": "select entry_id, list_source, name, version from v_part_list",
    "idempotent_ingest": """select n.case_id as request_id, n.tenant_id,
  case when nullif(n.idempotency_key,'') is null then n.case_id else
    first_value(n.case_id) over (partition by n.tenant_id, n.idempotency_key order by n.late, n.created_at, n.case_id) end as case_id,
  nullif(n.idempotency_key,'') is not null and n.case_id<>
    first_value(n.case_id) over (partition by n.tenant_id, n.idempotency_key order by n.late, n.created_at, n.case_id) as is_replay
from (select *, created_at>=timestamp '1998-01-01' as late from v_cases) n qualify n.late""",
    "keyed_upsert": """select s_suppkey as reviewer_id, s_nationkey as tenant_id, 'r'||(s_suppkey%40)||'@example.com' as email,
  case when s_suppkey%3=0 then 'auditor' when s_suppkey%17=0 then 'owner' else ['reviewer','admin','auditor'][s_suppkey%3+1] end as role
from supplier
union all select -s_suppkey, s_nationkey, null, 'auditor' from supplier where s_suppkey%6=0 and s_suppkey>0""",
    "soft_delete": """select s_suppkey as webhook_id, coalesce(case when s_acctbal<0 then timestamp '2024-01-01' end,
  (select min(ts) from events where user_id=s_suppkey and event_type='error')) as disabled_at from supplier""",
    "unique_conflicts": """select * from (
  select 'reviewer_email' as key_name, tenant_id||'|'||email as value, count(*) as n from v_reviewers group by 1, 2
  union all select 'reviewer_token', token_hash, count(*) from v_reviewers group by 1, 2
  union all select 'tenant_slug', slug, count(*) from v_tenants group by 1, 2
  union all select 'api_key_hash', key_hash, count(*) from v_api_keys group by 1, 2
  union all select 'case_idempotency', tenant_id||'|'||idempotency_key, count(*) from v_cases
    where idempotency_key is not null group by 1, 2
  union all select 'hit_name', l_orderkey||'|LIST-'||l_returnflag||'|Part '||l_partkey, count(*) from lineitem
    where l_quantity>=49 group by 1, 2) where n>1""",
    "apply_claims": """select c.tenant_id, c.case_id, c.subject_name, c.created_at, user_id as claimed_by_reviewer_id, ts as claimed_at
from v_cases c join (select event_id%(select count(*)//5 from orders) as case_id, user_id, ts,
  row_number() over (partition by event_id%(select count(*)//5 from orders) order by ts desc, event_id desc) as rn from events
  where event_id%13<>5) e
on e.case_id=c.case_id and rn=1 where c.status='needs_review'""",
    "decision_admission": """select decision_id, d.case_id, d.decision, case when c.case_id is null then 'not_found'
  when c.status='needs_review' then 'accepted' else 'conflict' end as outcome
from v_decisions d left join v_cases c on c.case_id=d.case_id and c.tenant_id=d.tenant_id""",
    "case_state": """select c.case_id, coalesce(m.status,c.status) as status, coalesce(m.risk_score,c.risk_score) as risk_score,
  coalesce(m.decision,c.decision) as decision, coalesce(m.decided_at,c.decided_at) as decided_at
from v_cases c left join (select case_id, arg_max(status,seq) filter (status is not null) as status,
  arg_max(risk_score,seq) filter (risk_score is not null) as risk_score,
  arg_max(decision,seq) filter (decision is not null) as decision,
  arg_max(decided_at,seq) filter (decided_at is not null) as decided_at from v_mutations group by 1) m on m.case_id=c.case_id""",
    "case_events": """select seq, '{"tenant_id": "'||tenant_id||'", "case_id": "'||m.case_id||'", "status": "'||m.status||
  '", "decision": '||coalesce('"'||m.decision||'"','null')||'}' as payload
from v_mutations m join v_cases c on c.case_id=m.case_id where m.status is not null""",
    "token_attribution": """select request_id,
  case when r.token_hash is not null and r.revoked_at is null then 'reviewer'
    when k.key_hash is not null and k.revoked_at is null then 'api_key' end as principal,
  case when r.token_hash is not null and r.revoked_at is null then r.tenant_id
    when k.key_hash is not null and k.revoked_at is null then k.tenant_id end as tenant_id,
  case when header is null or header not like 'Bearer %' then 'malformed' when trim(substr(header,8))='' then 'empty'
    when (r.token_hash is not null and r.revoked_at is null) or (k.key_hash is not null and k.revoked_at is null) then 'ok'
    when r.token_hash is not null or k.key_hash is not null then 'revoked' else 'unknown' end as outcome
from v_tokens t left join v_reviewers r on r.token_hash=sha256(trim(substr(header,8)))
left join v_api_keys k on k.key_hash=sha256(trim(substr(header,8)))""",
    "fk_violations": """select 'decision.case' as fk, decision_id::varchar as row_id, case_id::varchar as missing from v_decisions
where case_id not in (select case_id from v_cases)
union all select 'decision.reviewer', decision_id::varchar, reviewer_id::varchar from v_decisions
where reviewer_id not in (select reviewer_id from v_reviewers)
union all select 'delivery.webhook', delivery_id, webhook_id::varchar from v_deliveries
where webhook_id not in (select webhook_id from v_webhooks)
union all select 'case.tenant', case_id::varchar, tenant_id::varchar from v_cases
where tenant_id not in (select tenant_id from v_tenants)
union all select 'reviewer.tenant', reviewer_id::varchar, tenant_id::varchar from v_reviewers
where tenant_id not in (select tenant_id from v_tenants)
union all select 'webhook.tenant', webhook_id::varchar, tenant_id::varchar from v_webhooks
where tenant_id not in (select tenant_id from v_tenants)
union all select 'api_key.tenant', c_custkey::varchar, c_nationkey::varchar from customer
where c_nationkey not in (select tenant_id from v_tenants)
union all select 'document.case', document_id, case_id::varchar from v_documents
where case_id not in (select case_id from v_cases)
union all select 'extraction.case', concat_ws('-',l_linenumber,l_partkey,l_suppkey), l_orderkey::varchar from lineitem
where l_orderkey not in (select case_id from v_cases)
union all select 'extraction.document', concat_ws('-',l_linenumber,l_partkey,l_suppkey), l_orderkey||'-id_document-0' from lineitem
where l_orderkey||'-id_document-0' not in (select document_id from v_documents)
union all select 'hit.case', 'Part '||l_partkey, l_orderkey::varchar from lineitem
where l_quantity>=49 and l_orderkey not in (select case_id from v_cases)
union all select 'delivery.case', delivery_id, case_id::varchar from v_deliveries
where case_id not in (select case_id from v_cases)
union all select 'face_match.case', concat_ws('-',l_linenumber,l_partkey,l_suppkey), l_orderkey::varchar from lineitem
where l_quantity>10 and l_orderkey not in (select case_id from v_cases)
union all select 'audit.case', id::varchar, case_id::varchar from v_audit where case_id not in (select case_id from v_cases)
union all select 'case.reviewer', case_id::varchar, (case_id%110)::varchar from v_cases
where case_id%7=0 and case_id%110 not in (select reviewer_id from v_reviewers)
union all select 'document.tenant', document_id, tenant_id::varchar from v_documents
where tenant_id not in (select tenant_id from v_tenants)
union all select 'decision.tenant', decision_id::varchar, tenant_id::varchar from v_decisions
where tenant_id not in (select tenant_id from v_tenants)
union all select 'audit.tenant', id::varchar, tenant_id::varchar from v_audit where tenant_id not in (select tenant_id from v_tenants)
union all select kind||'.tenant', row_id, (l_orderkey%25+25)::varchar from (
  select 'extraction' as kind, concat_ws('-',l_linenumber,l_partkey,l_suppkey) as row_id, l_orderkey from lineitem
  union all select 'face_match', concat_ws('-',l_linenumber,l_partkey,l_suppkey), l_orderkey from lineitem where l_quantity>10
  union all select 'hit', 'Part '||l_partkey, l_orderkey from lineitem where l_quantity>=49
  union all select 'delivery', delivery_id, case_id from v_deliveries) where l_orderkey%500=7""",
    "status_counts": "select * from v_counts",
    "overview_cards": """select tenant_id, (sum(n) filter (status='needs_review'))::bigint as needs_review,
  (sum(n) filter (status in ('processing','pending')))::bigint as in_progress,
  (sum(n) filter (status='approved'))::bigint as approved, (sum(n) filter (status='rejected'))::bigint as rejected,
  count(*) filter (n>0) as shown_statuses from v_counts group by 1""",
    "weekly_volume": """select tenant_id, date_trunc('week',created_at)::date as week, count(*) as n from v_cases
where created_at > timestamp '2001-07-20' - interval 30 day group by all""",
    "doc_types": "select case_id, array_to_string(list_sort(list(distinct doc_type)),',') as doc_types from v_documents group by 1",
    "latest_extraction": "select case_id, evidence_id, confidence, face, created_at from v_latest",
    "recent_activity": """
created as (select tenant_id, case_id, subject_name, 'case created' as event, created_at as at from v_cases
  qualify row_number() over (partition by tenant_id order by created_at desc, case_id desc)<=10),
decided as (select c.tenant_id, c.case_id, c.subject_name, d.decision||' by '||r.email as event, d.decided_at as "at"
  from v_decisions d join v_cases c on c.case_id=d.case_id join v_reviewers r on r.reviewer_id=d.reviewer_id and r.tenant_id=c.tenant_id
  qualify row_number() over (partition by c.tenant_id order by d.decided_at desc, c.case_id desc, d.decision||' by '||r.email desc)<=10)
select tenant_id, case_id, subject_name, event, "at" from (select * from created union all select * from decided)
qualify row_number() over (partition by tenant_id order by "at" desc, case_id desc, event desc)<=10""",
    "admin_listing": "select reviewer_id, email, role, created_at, revoked_at from v_reviewers where tenant_id=3",
    "mrz_lines": """select document_id, case when document_id%17<>0 then line1 when document_id%3=0 then
  rpad('PASSPORTOFACOUNTRYTHATNEVERWASATALL',44,'<') end as line1,
  case when document_id%17<>0 then rpad(line2,44,'<') when document_id%3=0 then line1 end as line2 from v_mrz""",
    "mrz_validate": "select * from v_mrz_result",
    "response_resolve": "select document_id, full_name, document_number, date_of_birth, expiry_date, confidence, needs_review, reason from v_resolved",
    "extraction_resolve": """select coalesce(m.document_id,r.document_id) as document_id,
  case when m.document_id is not null then m.full_name else r.full_name end as full_name,
  case when m.document_id is not null then m.document_number else r.document_number end as document_number,
  case when m.document_id is not null then m.date_of_birth::varchar else r.date_of_birth end as date_of_birth,
  case when m.document_id is not null then 0.99 else r.confidence end as confidence,
  case when m.document_id is not null then 'mrz' else 'vlm' end as method,
  case when m.document_id is not null then false else r.needs_review end as needs_review,
  case when m.document_id is null then r.reason end as reason,
  case when m.document_id is not null then 'mrz-icao9303' else 'model' end as model_version
from (select * from v_mrz_result where valid) m full join v_resolved r on r.document_id=m.document_id""",
    "needs_model": "select document_id from v_mrz_result where not valid",
    "face_match": """
faces as (select vec_id//4 as case_id, (vec_id//2)%2 as side, embedding::double[] as e,
  row_number() over (partition by vec_id//2 order by (1+label%7)*(1+vec_id%5) desc, vec_id) as rn
  from embeddings where (vec_id//2)%10<>0),
scored as (select p.case_id, round(list_inner_product(a.e,b.e),6) as s from (select distinct vec_id//4 as case_id from embeddings) p
  left join faces a on a.case_id=p.case_id and a.side=0 and a.rn=1 left join faces b on b.case_id=p.case_id and b.side=1 and b.rn=1)
select case_id, s as similarity_score, s is null as needs_review,
  case when s is null then 'no face detected in image' end as reason from scored""",
    "risk_assessment": "select case_id, evidence_id, created_at, {RISK} from v_evidence",
    "case_decisions": "select * from v_decided",
    "review_resolution": "select * from v_resolution",
    "build_audit_chain": "select id, tenant_id, prev_row_hash, row_hash from v_chain",
    "verify_audit_chain": "select * from v_verified",
    "audit_chain_report": """select tenant_id, count(*) as n, count(*) filter (violations<>'') as n_broken,
  min(id) filter (violations<>'') as first_broken_id, case when count(*) filter (violations<>'')=0 then 'OK' else 'BROKEN' end as status
from v_verified group by 1""",
    "audit_events": _STEP_EVENTS,
    "step_payloads": """select case_id, step, case step
  when 'fetch_case_documents' then '{"doc_types_found": ['||concat_ws(', ', case when case_id%50<>7 then '"id_document"' end,
    case when case_id%40<>3 then '"selfie"' end)||']}'
  when 'extract_document' then '{"confidence": '||coalesce(case when conf is null then null when conf=floor(conf) then conf::int||'.0' else rtrim(printf('%.4f',conf),'0') end,'null')||', "method": "'||case when case_id%2=0 then 'mrz' else 'vlm' end
    ||'", "needs_review": '||(case_id%3=0)||'}'
  when 'face_match' then '{"needs_review": '||(case_id%3=0)||', "reason": '||why||', "similarity_score": '
    ||coalesce(case when face is null then null when face=floor(face) then face::int||'.0' else rtrim(printf('%.4f',face),'0') end,'null')||'}'
  when 'sanctions_screen' then '{"highest_score": '||coalesce(case when top is null then null when top=floor(top) then top::int||'.0' else rtrim(printf('%.4f',top),'0') end,'null')||', "hit_count": '||case_id%4||'}'
  when 'update_case_status' then '{"status": "'||status||'"}'
  when 'risk_score' then '{"needs_review": '||(case_id%3=0)||', "reason": '||why||', "risk_score": '
    ||coalesce(case when risk_score is null then null when risk_score=floor(risk_score) then risk_score::int||'.0' else rtrim(printf('%.4f',risk_score),'0') end,'null')||'}'
  when 'finalize_case' then '{"decision": '||coalesce('"'||decision||'"','null')||', "status": "'||status||'"}'
  when 'deliver_webhooks' then '{"delivered_count": '||case_id%3||', "failed_count": '||case_id%2||', "webhook_count": '
    ||(case_id%3+case_id%2)||'}' end as payload
from (select s.case_id, s.step, c.status, c.decision, c.risk_score, (s.case_id%101)/100 as conf,
  case when s.case_id%3=0 then '"score \\"low\\""' else 'null' end as why,
  case when s.case_id%83<>0 then (s.case_id%1001)/1000 end as face, case when s.case_id%4<>0 then (s.case_id%97)/100 end as top
  from v_steps s join v_cases c on c.case_id=s.case_id where s.outcome='completed')""",
    "audit_log": f"""select tenant_id, count(*) as n, 0::bigint as n_broken, 'OK' as status, max(id) as last_id from (
  select *, row_number() over (order by created_at, tenant_id, case_id, seq, event_type) as id from ({_STEP_EVENTS})) group by 1""",
    "orphan_steps": """select tenant_id, case_id, step, id, created_at from v_paired
where phase='started' and coalesce(next_phase,'started')='started'""",
    "step_durations": """select tenant_id, case_id, step, id, next_phase as outcome,
  round((epoch_us(next_at)-epoch_us(created_at))/1e6,6) as seconds from v_paired
where phase='started' and next_phase in ('completed','failed')""",
    "quota_admission": "select * from v_quota_result",
    "stream_case_events": """select *, '{"tenant_id": "'||tenant_id||'", "case_id": "'||case_id||'", "status": "'||status||
  '", "decision": null'||coalesce(', "claimed_by_reviewer_id": "'||claimed_by_reviewer_id||'"','')||'}' as payload
from (select event_id as seq, (user_id%25)::varchar as tenant_id, event_id::varchar as case_id,
    case when event_type='click' then 'needs_review' else event_type end as status, null::varchar as decision,
    case when event_type='click' then user_id::varchar end as claimed_by_reviewer_id
  from events where event_id%13<>0)""",
    "stream_quota": "select * from v_quota_result",
    "stream_audit_chain": "select id, tenant_id, prev_row_hash, row_hash from v_chain",
    "stream_ingest": """select case_id as request_id, tenant_id, coalesce(case when nullif(idempotency_key,'') is not null then
    first_value(case_id) over (partition by tenant_id, idempotency_key order by created_at, case_id) end, case_id) as case_id,
  nullif(idempotency_key,'') is not null and case_id<>
    first_value(case_id) over (partition by tenant_id, idempotency_key order by created_at, case_id) as is_replay
from v_cases""",
    "stream_status_counts": """select status, count(*) as n from (
  select case_id, arg_max(status,seq) as status from v_mutations where status is not null group by 1) group by 1""",
    "stream_case_lifecycle": "select case_id, final_status from v_resolution",
    "photo_pair_digest": """select a.doc_id as case_id, case when a.doc_id%6<>0 and b.doc_id%6<>0 then sha256(a.text||b.text) end as input_hash
from documents a left join documents b on b.doc_id=a.doc_id+1 where a.doc_id%2=0""",
    "blob_digest": """select doc_id, case when doc_id%6<>0 then sha256(text) end as sha256, doc_id%6<>0 as is_uploaded from documents""",
    "evidence_numeric": """select case_id, evidence_id, created_at, confidence::decimal(5,4)::double as confidence,
  face::decimal(5,4)::double as face from v_evidence""",
    "json_fields": "select event_id, (props->>'k')::bigint as k from events",
}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, body in BODIES.items():
        body = body.strip()
        # Bodies that start with their own views continue the list of the shared ones.
        if re.match(r"^\w+ as \(", body):
            shared = with_views(body)
            out[name] = re.sub(r"\)\n(\w+ as \()", r"),\n\1", shared, count=1) if "with recursive" in shared else f"with {shared}"
        else:
            out[name] = with_views(body)
    return out
