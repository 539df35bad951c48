"""DuckDB SQL of the corpus queries that SQL can express."""

SQL = {
    "op3_near_dedup": r"""
        with recursive docs as (
            select doc_id, regexp_extract_all(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x20\x09-\x0D]+') as words
            from documents
        ), shingles as materialized (
            select distinct doc_id, hash(array_to_string(words[i : i + 1], ' ')) as s
            from (select doc_id, words, unnest(range(1, greatest(len(words), 2))) as i from docs where len(words) > 0)
        ), sizes as materialized (select doc_id, count(*) as n from shingles group by doc_id),
        links as materialized (
            select a.doc_id as x, b.doc_id as y
            from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id
                 join sizes m on m.doc_id = a.doc_id join sizes n on n.doc_id = b.doc_id
            where 100 * least(m.n, n.n) >= 80 * greatest(m.n, n.n)
            group by a.doc_id, b.doc_id, m.n, n.n
            having 100 * count(*) >= 80 * (m.n + n.n - count(*))
        ), reach as (
            select doc_id as x, doc_id as y from docs
            union
            select r.x, l.y from reach r join links l on r.y = l.x
        ), least as (select x as doc_id, min(y) as component_id from reach group by x)
        select d.doc_id, coalesce(s.n, 0) as n_shingles, l.component_id, d.doc_id = l.component_id as kept
        from docs d left join sizes s using (doc_id) join least l using (doc_id)
    """,
    "op4_substring_dedup": r"""
        with docs as (
            select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
        ), places as (
            select doc_id, i, md5(array_to_string(words[i : i + 34], ' ')) as h
            from (select doc_id, words, unnest(range(1, len(words) - 35 + 2)) as i from docs)
        ), marked as (
            select doc_id, list(distinct k) as gone from (
                select doc_id, unnest(range(i, i + 35)) as k
                from places where h in (select h from places group by h having count(*) > 1)
            ) group by doc_id
        ), spelled as (
            select d.doc_id, len(d.words) as n_words, coalesce(len(m.gone), 0) as n_removed,
                   list_filter(d.words, lambda w, k: m.gone is null or not list_contains(m.gone, k)) as kept
            from docs d left join marked m using (doc_id)
        )
        select doc_id, cast(n_words as bigint) as n_words, cast(n_removed as bigint) as n_removed,
               sha256(array_to_string(kept, ' ')) as kept_sha256
        from spelled
    """,
    "op5_chat_format": r"""
        with rows as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
        ), escaped as (
            select *, regexp_replace(replace(text, '\', '\\'),
                                     '(<|\[)(\|[A-Za-z_]+\|>|/?s>|/?INST\]|</?SYS>>|</SYS>>)', '\1\\\2', 'g') as safe
            from rows
        )
        select conv_id, count(*) as n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
               cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
               sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
               cast(sum(length('<|turn|>') + length(role) + 1 + length(safe) + length('<|end|>') + 1) as bigint) as formatted_chars
        from escaped group by conv_id
    """,
    "op8_exact_dedup": """
        select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
               doc_id is not distinct from max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
        from documents
        window same as (partition by coalesce(text, ''))
    """,
    "op10_decontamination": r"""
        with doc_words as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
            from documents
        ), item_words as (
            select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
            from benchmark
        ), phrases as (
            select distinct item_id, least(len(words), 10) as size,
                   array_to_string(words[i : i + least(len(words), 10) - 1], ' ') as phrase
            from (select item_id, words, unnest(range(1, greatest(len(words) - 10 + 1, 1) + 1)) as i
                  from item_words where len(words) > 0)
        ), sizes as (select distinct size from phrases),
        places as (
            select doc_id, i, size, array_to_string(words[i : i + size - 1], ' ') as phrase
            from (select doc_id, words, size, unnest(range(1, len(words) - size + 2)) as i from doc_words, sizes)
        ), found as (
            select p.doc_id, p.i, p.size, q.item_id from places p join phrases q using (size, phrase)
        ), hit as (
            select doc_id, count(distinct k) as n_hit
            from (select doc_id, unnest(range(i, i + size)) as k from (select distinct doc_id, i, size from found))
            group by doc_id
        ), named as (
            select doc_id, count(distinct item_id) as n_items,
                   array_to_string(list_sort(list(distinct cast(item_id as varchar))), ',') as items
            from found group by doc_id
        )
        select d.doc_id, cast(len(d.words) as bigint) as n_words, coalesce(h.n_hit, 0) as n_hit,
               coalesce(n.n_items, 0) as n_items, sha256(coalesce(n.items, '')) as items_sha256,
               h.n_hit is not null as contaminated
        from doc_words d left join hit h using (doc_id) left join named n using (doc_id)
    """,
    "op12_resampling": r"""
        with crc as (
            select list(list_reduce(list_concat([i], range(8)),
                                    lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t
            from range(256) r(i)
        ), doc_words as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
            from documents
        ), doc_counts as (
            select doc_id, word, count(*) as n from (select doc_id, unnest(words) as word from doc_words) group by all
        ), item_counts as (
            select word, count(*) as n from (
                select unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word from benchmark
            ) group by word
        ), coded as (
            select word, hex(encode(word)) as code from (select word from doc_counts union select word from item_counts)
        ), hashed as (
            select word, xor(list_reduce(list_concat([4294967295],
                                list_transform(range(0, length(code) // 2), lambda k: ('0x' || substr(code, 2 * k + 1, 2))::bigint)),
                                lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 as bucket
            from coded, crc
        ), s as (select bucket, sum(n)::bigint as s from doc_counts join hashed using (word) group by bucket),
        t as (select bucket, sum(n)::bigint as t from item_counts join hashed using (word) group by bucket),
        gains as (
            select bucket, floor(1000 * ln((coalesce(t, 0) + 1.0::double) * ((select coalesce(sum(s), 0) from s) + 10000)
                                 / ((coalesce(s, 0) + 1.0::double) * ((select coalesce(sum(t), 0) from t) + 10000))))::bigint as gain
            from s full join t using (bucket)
        ), weights as (
            select doc_id, floor(sum(n * gain)::double / sum(n))::bigint as weight
            from doc_counts join hashed using (word) join gains using (bucket) group by doc_id
        ), drawn as (
            select doc_id, len(words) as n_features, coalesce(weight, 0) as weight,
                   ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint as h
            from doc_words left join weights using (doc_id)
        ), scored as (
            select doc_id, n_features, weight,
                   weight + floor(-1000.0::double * ln(-ln((h + 0.5::double) / 4294967296.0::double)))::bigint as score,
                   n_features >= 20 as able
            from drawn
        ), ranked as (
            select *, row_number() over (partition by able order by score desc, doc_id) as place,
                   count(*) filter (able) over () as total
            from scored
        )
        select doc_id, cast(n_features as bigint) as n_features, weight, score,
               case when able and place <= 10 * total // 100 then place end as rank
        from ranked
    """,
    "op13_hard_negatives": """
        with rows as (
            select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                   list_transform(embedding, lambda x: floor(256.0::double * x::double)) as v
            from embeddings
            where label is not null and embedding is not null
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), anchors as (select * from rows where vec_id % 50 = 0),
        scores as (
            select a.vec_id as anchor_id, r.vec_id, a.label = r.label as same, list_dot_product(a.v, r.v)::bigint as score
            from anchors a join rows r on a.vec_id <> r.vec_id
        ), positives as (
            select anchor_id, vec_id as positive_id, score as positive_score
            from scores where same
            qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
        )
        select anchor_id, positive_id,
               cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as integer) as rank,
               vec_id as negative_id, positive_score, score as negative_score
        from positives join scores using (anchor_id)
        where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
        qualify rank <= 3
    """,
}
