"""Plain SQL twins of the registered queries, written from the derivation rules.

``BASES`` holds the derived tables as common table expressions; a twin names
the ones it needs.
"""

from __future__ import annotations

BASES = {
    # Conversations as linked rows, all of them and the readable ones.
    "al": """al as (select conv_id c, turn t, cast(conv_id as varchar) session_id, turn + 1 line, role, text,
        (role = 'system' or (conv_id + turn) % 11 = 7) bnd,
        case when role = 'system' or (conv_id + turn) % 11 = 7 then 'system'
             when (conv_id + 2 * turn) % 23 = 11 then 'file-history-snapshot' else role end typ,
        concat(conv_id, '-', turn) uuid,
        case when turn = 0 then null when (conv_id * 7 + turn) % 13 = 0 then concat(conv_id, '-x', turn)
             when turn >= 2 and (conv_id + turn) % 9 = 4 then concat(conv_id, '-', turn - 2)
             else concat(conv_id, '-', turn - 1) end parent,
        (conv_id + turn) % 29 = 13 bad, (conv_id * 5 + turn) % 19 = 3 api, turn = 0 and conv_id % 7 = 2 meta,
        conv_id % 13 = 4 side, 1704067200 + conv_id * 3600 + turn * 60 sec,
        concat('sess-', case when (conv_id + turn) % 31 = 5 then conv_id + 1 else conv_id end) sid,
        role = 'assistant' and (conv_id + turn) % 3 = 0 think,
        role = 'assistant' and turn % 4 <> 3 has_use, role = 'user' and turn >= 1 has_res,
        role = 'user' and turn >= 1 and conv_id % 5 = 0 has_late,
        case when role = 'assistant' then concat('msg-', conv_id, '-', turn // 3) end mkey
        from conversations)""",
    "a": "a as (select *, typ in ('user', 'assistant') msg from al where not bad)",
    "refs": """refs as (select session_id, line, 'use' side, concat(c, ':', t) id from a where has_use
        union all select session_id, line, 'result', concat(c, ':', t - 1) from a where has_res
        union all select session_id, line, 'result', concat(c, ':', t + 50) from a where has_late)""",
    # Events as flat rows.
    "b": """b0 as (select user_id u, cast(user_id as varchar) session_id, event_id e, event_id + 1 line, event_type, ts, value,
        case when event_id % 41 <> 7 then concat(user_id, ':', event_id % 24) end cid,
        case when event_id % 211 = 17 then 'invalid_json' when event_id % 223 = 19 then 'unknown_json'
             when event_id % 227 = 23 then 'non_object' else 'wrapped' end kind,
        case when event_id % 97 = 5 then 'session_meta' when event_type <> 'error' then 'response_item'
             when event_id % 5 = 0 then 'compacted' when event_id % 5 = 1 then 'turn_context'
             when event_id % 5 = 4 then 'event_msg' else 'response_item' end typ0,
        case when event_id % 7 = 0 then true else false end ctx,
        concat('event ', event_type, ' value ', cast(floor(value) as bigint), ' ', case when event_id % 7 = 0 then
          concat('<environment_context><cwd>/work/p', user_id % 10, '</cwd></environment_context>') else '' end) note,
        case event_id % 4 when 0 then 'developer' when 2 then 'assistant' else 'user' end mrole
        from events),
      b as (select *, case when kind = 'wrapped' then typ0 end typ,
        case when kind <> 'wrapped' or typ0 <> 'response_item' then null when event_type = 'click' then 'function_call'
             when event_type = 'view' then 'function_call_output' when event_type = 'purchase' then 'custom_tool_call'
             when event_type = 'signup' then 'custom_tool_call_output' when e % 5 = 2 then 'local_shell_call'
             else 'message' end itype from b0)""",
    "calls": """calls as (select session_id, line, cid, itype,
        case when itype like '%output' then 'output' else 'call' end side,
        case when itype like 'custom%' then 'custom' when itype = 'local_shell_call' then 'local_shell' else 'function' end k
        from b where itype is not null and itype <> 'message' and cid is not null)""",
    "pairs": """pairs as (select session_id, cid, count(*) filter (side = 'call') calls, count(*) filter (side = 'output') outputs,
        max(line) filter (side = 'call') call_line, arg_max(k, line) filter (side = 'call') ck,
        min(line) filter (side = 'output') out_line, arg_min(k, line) filter (side = 'output') ok
        from calls group by all),
      paired as (select *, coalesce((ck = 'custom') = (ok = 'custom'), false) fits from pairs)""",
    # Legacy sessions.
    "lg": """lg as (select concat('L', user_id) session_id, 1 line, 'legacy_meta' kind, null itype, null cid, user_id u, -1 e from events group by user_id
      union all select concat('L', user_id), event_id + 2, case when event_type = 'error' and event_id % 5 = 1 then 'invalid_json' else 'legacy_record' end,
        case event_type when 'click' then 'function_call' when 'view' then 'function_call_output' when 'purchase' then 'message'
          when 'signup' then null else case when event_id % 5 > 1 then 'reasoning' end end,
        case when event_type in ('click', 'view') and event_id % 41 <> 7 then concat(user_id, ':', event_id % 24) end, user_id, event_id from events)""",
    # Long linked sessions from events.
    "r": """r0 as (select cast(user_id as varchar) session_id, user_id u, event_id e, event_id + 1 line, event_type, ts,
        lag(event_id) over w prev, lag(event_id, 2) over w prev2,
        case when event_type in ('click', 'view', 'purchase') then 'assistant' else 'user' end role,
        event_type in ('click', 'view', 'purchase') and event_id % 7 < 3 think, concat('m', event_id // 4000) mkey
        from events window w as (partition by user_id order by event_id)),
      r as (select *, concat(session_id, '-', e) uuid, case when prev is null then null
        when e % 50 = 11 then concat(session_id, '-x', e) when e % 37 = 5 and prev2 is not null then concat(session_id, '-', prev2)
        else concat(session_id, '-', prev) end parent from r0)""",
    # The event log.
    "lg0": """ev as (select cast(user_id as varchar) session_id, user_id u, event_id + 1 line, event_id e, date_trunc('milliseconds', ts) ts,
        case event_type when 'signup' then 'session_start' when 'view' then 'auto_compact_start' when 'click' then 'heartbeat' else 'auto_compact' end event,
        case event_type when 'purchase' then 'success' when 'error' then 'failed' end result,
        case when event_type <> 'click' then 50000 + user_id end threshold,
        case when event_type <> 'signup' then cast(floor(value * 1000) as bigint) end tokens,
        case when event_type = 'purchase' then cast(floor(value * 500) as bigint) end tokens_after, value, event_type
        from events)""",
    # Chains of the conversations.
    "chain": """used as (select distinct session_id, parent uuid from a where parent is not null),
      leaf as (select session_id, arg_max(uuid, sec * 100 + line) uuid from a where not exists
        (select 1 from used where used.session_id = a.session_id and used.uuid = a.uuid) group by session_id),
      chain as (select a.session_id, a.uuid, a.line, a.parent, 0 depth from a join leaf using (session_id, uuid)
        union all select a.session_id, a.uuid, a.line, a.parent, chain.depth + 1
        from chain join a on a.session_id = chain.session_id and a.uuid = chain.parent)""",
    "sizes": """sizes as (select a.session_id, a.line, depth,
        (case when role = 'assistant' or has_res then
           (case when think then (strlen(concat('think ', t, chr(10))) + 3) // 4 else 0 end)
           + (case when has_res then (strlen(concat('done ', t)) + 3) // 4 else 0 end) + (case when has_late then 1 else 0 end)
           + (case when length(text) > 0 then (strlen(text) + (case when text like '%' || chr(10) then 0 else 1 end) + 3) // 4 else 0 end)
           + (case when has_use then (strlen(concat('[tool: tool', t % 3, ']', chr(10))) + 3) // 4
                 + (strlen(concat('{"q":', t, '}', chr(10))) + 3) // 4 else 0 end)
         else (strlen(text) + (case when text like '%' || chr(10) then 0 else 1 end) + 3) // 4 end)::bigint tokens
        from a join chain using (session_id, line) where msg)""",
}


def sql(bases: str, body: str) -> str:
    names = bases.split()
    recursive = "recursive " if "chain" in names or "recursive" in names else ""
    parts = [BASES[n] for n in names if n != "recursive"]
    return f"with {recursive}" + ",\n".join(parts) + "\n" + body if parts else body
