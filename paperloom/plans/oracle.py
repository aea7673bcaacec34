"""SQL for DuckDB that answers the same questions as ``plans.queries`` on the same tables."""

from __future__ import annotations

from paperloom.functions.text import SEARCH_STOPWORDS, TRAINER_STOPWORDS
from paperloom.plans.queries import BARREL, CATEGORY, EXPANDED, PAIR, PREFIX, SINGLE
from paperloom.plans.stored import WIDTH


def _words(words) -> str:
    return "(" + ",".join(f"'{w}'" for w in words) + ")"


STOP, STOP2 = _words(SEARCH_STOPWORDS), _words(TRAINER_STOPWORDS)
# texts are lines of key and content; a line whose key is not in the map is skipped, and a later line of a key replaces an earlier one
MAPPED = "mapped as (select doc_key, max(doc_id) doc_id from id_map where doc_key is not null group by 1)"
LASTDOC = "lastdoc as (select * from documents where doc_key is not null qualify row_number() over (partition by doc_key order by doc_id desc)=1)"
CORPUS = f"{MAPPED}, {LASTDOC}, corpus as (select m.doc_id, l.doc_key, coalesce(text,'') text from lastdoc l join mapped m using(doc_key))"
TOK = (f"{CORPUS}, tok as (select doc_id, unnest(list_transform(regexp_extract_all(text,'[A-Za-z0-9]+'), lambda x: lower(x))) w, "
       "generate_subscripts(regexp_extract_all(text,'[A-Za-z0-9]+'),1) p from corpus)")
KEEP = f"{TOK}, keep as (select * from tok where w not in {STOP})"
POST = f"{KEEP}, post as (select doc_id, w word, count(*) tf from keep group by 1,2)"
LEN = "len as (select c.doc_id, cast(count(k.w) as bigint) dl from corpus c left join keep k on k.doc_id=c.doc_id group by 1)"
META = ("meta as (select m.doc_id, l.doc_key id, substring(trim(split_part(coalesce(text,''),chr(10),1)),1,60) title, "
        "coalesce(source,'Unknown') authors, coalesce(category,'N/A') category, coalesce(strftime(fetched_at,'%Y-%m-%d'),'N/A') date "
        "from lastdoc l join mapped m using(doc_key))")
C1 = r"translate(coalesce({},''), chr(10)||chr(9)||chr(13), '   ')"
C2 = r"case when coalesce({0},'')='' then 'Unknown' else trim(replace(translate({0},'|'||chr(10)||chr(9),'-  '),chr(13),'')) end"
N1 = "regexp_replace(regexp_replace({},'^arXiv:',''),'v[0-9]+$','')"
N2 = r"regexp_replace(regexp_replace(replace({},'arXiv:',''),'^\s+|\s+$','','g'),'v[0-9]+$','')"
CONTENT = "||' '||".join(C1.format(c) for c in ("title", "authors", "abstract", "categories", "update_date"))
EDGES = "e as (select src, dst from graph_edges where src is not null and dst is not null)"
FLAT = "flat as (select distinct doc_id, word_id, freq from forward_index where freq > 0)"


def _search(terms: str, where: str = "true", order: str = "score desc, doc_id", lim: str = "true", extra: str = "", bonus: str = "0",
            cap: int = 120) -> str:
    """The search as CTEs ending in ``res``."""
    t = _words(sorted(set(terms.split())))
    k = len(set(terms.split()))
    return (f"with {extra} {POST}, {LEN}, {META}, l as (select * from len where {lim}), st as (select count(*) n_docs, avg(dl) avgdl from l), "
            f"h as (select * from post where word in {t}), dfs as (select word, count(*) df from h group by 1), "
            "sc as (select h.doc_id, count(*) m, sum(ln((n_docs-df+0.5)/(df+0.5)+1.0)*(tf*2.5)/(tf+1.5*(0.25+0.75*dl/avgdl))) s "
            f"from h join dfs using(word) join l using(doc_id), st group by 1 having count(*)={k}), "
            f"rs as (select sc.doc_id, m.id, m.title, m.authors, m.category, m.date, cast(round(s+{bonus},6) as double) score from sc join meta m on m.doc_id=sc.doc_id "
            f"where {where}), res as (select cast(row_number() over (order by {order}) as bigint) as rank, * from rs order by {order} limit {cap})")


def _pagerank(n: int) -> str:
    """CTEs pr0..prN of ``n`` rounds over ``e``."""
    out = [EDGES, "nodes as (select src id from e union select dst from e)", "cnt as (select count(*) n from nodes)",
           "deg as (select src, count(*) d from e group by 1)",
           "ew as (select e.src, e.dst, count(*)/max(d) w from e join deg using(src) group by 1,2)",
           "pr0 as materialized (select id, 1.0::double/n score from nodes, cnt)"]
    for i in range(n):
        out.append(
            f"pr{i+1} as materialized (select p.id, 0.15/n + 0.85*coalesce(dm,0)/n + 0.85*coalesce(s,0) score from pr{i} p "
            f"left join (select dst, sum(score*w) s from ew join pr{i} q on q.id=ew.src group by 1) x on x.dst=p.id, "
            f"(select sum(score) dm from pr{i} where id not in (select src from deg)) y, cnt)")
    return ", ".join(out)


TW = rf"list_transform(regexp_split_to_array(t, '[ \t\n\x0B\f\r]+'), lambda w: lower(regexp_replace(w,'[^A-Za-z0-9]','','g')))"
TROWS = (f"{CORPUS}, rws as (select doc_id, list_filter({TW.replace('(t,', '(doc_key||chr(9)||text,')}, lambda w: length(w)>2 and w not in {STOP2}) ws from corpus), "
         "tw as (select doc_id, unnest(ws) w, generate_subscripts(ws,1) p from rws), "
         "voc as (select w word, count(*) freq from tw group by 1 having count(*)>=50 order by 2 desc, 1 desc limit 50000), "
         "vt as (select doc_id, w, row_number() over (partition by doc_id order by p) i from tw where w in (select word from voc))")
COOC = (f"{TROWS}, pairs as (select a.w target, b.w context, count(*) cnt from vt a join (select 0-k k from range(1,6) r(k) union all select k from range(1,6) r(k)) o on true "
        "join vt b on b.doc_id=a.doc_id and b.i=a.i+o.k group by 1,2), "
        "top20 as (select * from (select target, cast(row_number() over (partition by target order by cnt desc, context desc) as bigint) as rank, context, cnt from pairs) where rank<=20)")
_Q = EXPANDED.lower().split()
SYN = (f"{COOC}, asked as (select * from (values {','.join(f'({i},{chr(39)}{w}{chr(39)})' for i, w in enumerate(_Q))}) v(pos,target)), "
       f"used as (select context, min((pos,rank,target)) f from top20 join asked using(target) where rank<=2 and context not in {_words(_Q)} group by 1), "
       "syns as (select cast(row_number() over (order by f) as bigint) seq, f[3] word, context syn from used)")
_ORPH = (f"ids as (select {N2.format('doc_key')} k, doc_id, mapped_at, deleted_at from id_map), refs as ("
         f"select 'doc_metadata' tab, 'original_id' field, line_no row_id, {N2.format('original_id')} k, loaded_at t from doc_metadata where {N2.format('original_id')} not in ('','UnknownID') "
         "union all select 'graph_edges','src',edge_id, cast(src as varchar), loaded_at from graph_edges where src is not null "
         "union all select 'graph_edges','dst',edge_id, cast(dst as varchar), loaded_at from graph_edges where dst is not null "
         "union all select 'search_results','doc_id',hit_id, cast(doc_id as varchar), ran_at from search_results where doc_id is not null), "
         "par as (select 'doc_metadata' tab, k, mapped_at, deleted_at from ids union all select 'other', cast(doc_id as varchar), mapped_at, deleted_at from ids), "
         "judged as (select r.tab, field, row_id, t, count(p.k) n, count(*) filter (mapped_at<=t) b, count(*) filter (mapped_at<=t and (deleted_at is null or deleted_at>t)) a "
         "from refs r left join par p on p.k=r.k and p.tab=case when r.tab='doc_metadata' then r.tab else 'other' end group by 1,2,3,4), "
         "orph as (select tab, field, row_id, case when n=0 then 'missing' when b=0 then 'late' else 'deleted' end kind, strftime(t,'%Y-%m') period from judged where a=0)")


def _expanded(prim: str, bonus: str) -> str:
    """The primary search ``prim`` followed by those of the associated words."""
    return (
        prim.replace("with ", f"with {SYN}, ", 1).replace(f"{CORPUS}, tok as", "tok as", 1)
        + ", sdf as (select word, count(*) df from post where word in (select syn from syns) group by 1), "
        f"sx as (select seq, syn, p.doc_id, round(ln((n_docs-df+0.5)/(df+0.5)+1.0)*(tf*2.5)/(tf+1.5*(0.25+0.75*dl/avgdl))+{bonus},6) score from post p join syns on syn=p.word join sdf on sdf.word=p.word join len using(doc_id), st), "
        "sp as (select *, row_number() over (partition by seq order by score desc, doc_id) place from sx), "
        "al as (select 0 src, 0 seq, rank place, doc_id, id, title, authors, category, date, score from res union all "
        "select 1, seq, place, m.doc_id, id, '[Related to '||syn||'] '||title, authors, category, date, sp.score*0.5 from sp join meta m on m.doc_id=sp.doc_id where place<=120), "
        "dd as (select *, row_number() over (partition by id order by src, seq, place) o from al), "
        "rk as (select *, row_number() over (order by src, seq, place) rr from dd where o=1) "
        "select rr as rank, doc_id, id, title, authors, category, date, round(score,6) score from rk where src=0 or rr<=60")


def core_sql() -> dict[str, str]:
    """SQL by query name."""
    q: dict[str, str] = {}
    q["tokenize"] = f"with {TOK} select doc_id, w word, count(*) tf from tok group by 1,2"
    q["tokenize_nostop"] = f"with {POST} select * from post"
    q["clean_text"] = f"select line_no, {C1.format('title')} title, {CONTENT} content from raw_papers"
    q["id_normalize"] = f"select line_no, {N1.format('id')} graph_key, {N2.format('id')} meta_key from raw_papers"
    q["metadata_clean"] = "select line_no, " + ", ".join(f"{C2.format(c)} {a}" for c, a in (
        ("title", "title"), ("authors", "authors"), ("categories", "category"), ("update_date", "date"))) + " from raw_papers"
    q["src_jsonl_clean"] = f"select line_no, coalesce(id,'Unknown') doc_key, {CONTENT} content from raw_papers"
    line = f"concat_ws(chr(9), {C1.format('id')}, abstract)"
    q["src_tsv_split"] = (f"select line_no, substring({line},1,instr({line},chr(9))-1) doc_key, substring({line},instr({line},chr(9))+1) content "
                          f"from raw_papers where instr({line},chr(9))>0")
    q["src_tsv_file"] = f"select {C1.format('id')} doc_key, {C1.format('title')}||' '||{C1.format('abstract')} as content from raw_papers"
    q["src_whole_files"] = "select n_name||chr(10)||n_regionkey||chr(10) as value from nation"
    q["src_citation_explode"] = ("select cast(src as varchar) src, cast(dst as varchar) ref, count(*) n from graph_edges where src is not null group by 1,2")
    ln = "list_transform(string_split(concat_ws('|',coalesce(original_id,''),coalesce(title,''),coalesce(authors,''),coalesce(category,'')),'|'), lambda x: x)"
    q["metadata_parse"] = "select line_no, " + ", ".join(
        f"coalesce(({ln})[{i+1}],'') {c}" for i, c in enumerate(("original_id", "title", "authors", "category", "date"))) + " from doc_metadata"
    q["id_map"] = f"with {CORPUS} select doc_key, row_number() over (order by doc_key) - 1 doc_id from corpus"
    lex = "lx as (select row_number() over (order by f)-1 word_id, word from (select w word, min((doc_id,p)) f from keep group by 1))"
    q["lexicon"] = f"with {KEEP}, {lex} select * from lx"
    q["forward_index"] = (f"with {POST}, {lex}, t as (select doc_id, cast(sum(tf) as bigint) total, count(*) uniq from post group by 1) "
                          "select doc_id, word_id, tf freq, total, uniq from post join lx using(word) join t using(doc_id)")
    q["doc_lengths"] = f"with {KEEP}, {LEN} select * from len"
    q["doc_lengths_universe"] = (f"with {FLAT}, s as (select doc_id, sum(freq) dl from flat group by 1) select i.doc_id, cast(coalesce(dl,0) as bigint) dl "
                                 "from (select distinct doc_id from id_map) i left join s on s.doc_id is not distinct from i.doc_id")
    q["corpus_stats"] = f"with {KEEP}, {LEN} select count(*) n_docs, round(avg(dl),6) avgdl from len"
    q["inverted_index"] = (f"with {POST} select word, count(*) df, cast(sum(tf) as bigint) cf, cast(sum(doc_id) as bigint) sum_doc, min(doc_id) min_doc, "
                           "max(doc_id) max_doc from post group by 1")
    q["inverted_lists"] = (f"with {POST} select word, doc_id//{BARREL} block, string_agg(doc_id||':'||tf, ' ' order by doc_id) postings from post group by 1,2")
    q["barrel_postings"] = f"with {POST}, {lex} select cast(word_id//{WIDTH} as integer) barrel, word_id, doc_id, tf freq from post join lx using(word)"
    q["index_build"] = (f"with {POST}, {lex} select 'docs' as name, count(*) n from corpus union all select 'meta', count(*) from corpus union all select 'lengths', count(*) from corpus "
                        "union all select 'postings', count(*) from post union all select 'barrels', count(*) from post union all select 'lexicon', count(*) from lx")
    q["barrel_stats"] = f"with {FLAT}, w as (select word_id, count(*) n from flat group by 1) select word_id//{BARREL} barrel, count(*) n_words, cast(sum(n) as bigint) n_postings from w group by 1"
    q["postings_lookup"] = f"with {POST} select doc_id, tf from post where word='{SINGLE}'"
    idf = "ln((n_docs-df+0.5)/(df+0.5)+1.0)"
    st = "st as (select count(*) n_docs, avg(dl) avgdl from len), dfs as (select word, count(*) df from post group by 1)"
    q["idf"] = f"with {POST}, {LEN}, {st} select word, df, round({idf},6) idf from dfs, st"
    q["bm25_term"] = (f"with {POST}, {LEN}, {st} select doc_id, word, round({idf}*(tf*2.5)/(tf+1.5*(0.25+0.75*dl/avgdl)),6) weight "
                      "from post join dfs using(word) join len using(doc_id), st")
    fields = "title authors category date".split()
    src = dict(zip(fields, ("title", "authors", "categories", "update_date")))
    q["metadata_extract"] = (
        "with ids as (select doc_key, max(doc_id) doc_id from id_map group by 1), pm as (select line_no, "
        f"{N2.format('id')} doc_key, " + ", ".join(f"{C2.format(src[f])} {f}" for f in fields) + " from raw_papers), "
        "f as (select * from (select i.doc_id, p.*, row_number() over (partition by i.doc_id order by line_no desc) rn from pm p join ids i on i.doc_key=p.doc_key) where rn=1) "
        "select u.doc_id, coalesce(f.doc_key,'UnknownID') original_id, coalesce(title,'Unknown Title (Doc #'||u.doc_id||')') title, coalesce(authors,'Unknown') authors, "
        "coalesce(category,'N/A') category, coalesce(date,'N/A') date from (select unnest(range(0,(select max(doc_id)+1 from ids))) doc_id) u left join f on f.doc_id=u.doc_id")
    out = " select rank, doc_id, id, title, authors, category, date, score from res"
    q["search_single"] = _search(SINGLE) + out
    q["search_and"] = _search(PAIR) + out
    q["search_stopwords_only"] = _search(SINGLE) + out + " where false"
    q["search_unknown_term"] = _search(f"{SINGLE} zzzzqx") + out
    q["search_category"] = _search(PAIR, where=f"contains(m.category,'{CATEGORY}')") + out
    q["search_date_sort"] = _search(PAIR, order="date desc, score desc, doc_id") + out
    q["search_doc_limit"] = _search(PAIR, lim="doc_id<500") + out
    q["hybrid_search"] = _search(PAIR, extra=_pagerank(10) + ",", bonus="50*coalesce((select max(score) from pr10 where pr10.id=sc.doc_id),0)") + out
    q["paginate"] = _search(PAIR) + out + " where rank between 21 and 40"
    q["result_json"] = _search(PAIR) + (
        " select rank, to_json(struct_pack(id:=id,title:=title,authors:=authors,category:=category,date:=date,score:=printf('%.4f',score))) json from res")
    q["result_display"] = _search(PAIR) + (
        " select rank, title||' / '||case when length(authors)>80 then substring(authors,1,80)||'...' else authors end||' / https://arxiv.org/abs/'||id line from res")
    q["graph_edges"] = f"with {EDGES} select src, dst, count(*) n from e group by 1,2"
    q["graph_nodes"] = f"with {EDGES} select src id from e union select dst from e"
    q["graph_degree"] = f"with {EDGES} select src, count(*) degree from e group by 1"
    q["graph_dangling"] = f"with {EDGES} select distinct dst id from e where dst not in (select src from e)"
    q["pagerank_iter10"] = f"with {_pagerank(10)} select id, round(score,10) score from pr10"
    keyed = ("lines as (select cast(src as varchar) s, cast(dst as varchar) r from graph_edges where src is not null), "
             "ks as (select doc_key, row_number() over (order by doc_key)-1 id from (select s doc_key from lines union select r from lines where r is not null))")
    q["graph_build"] = f"with {keyed} select a.id src, b.id dst, count(*) n from lines join ks a on a.doc_key=s join ks b on b.doc_key=r group by 1,2"
    q["graph_build_nodes"] = f"with {keyed} select id, doc_key, (select count(r) from lines where s=doc_key) degree from ks"
    # rounds stop by the L1 change; by this many it is below the bound on any graph with this damping
    q["pagerank"] = f"with {_pagerank(50)} select id, round(score,10) score from pr50"
    q["suggest_vocab"] = f"with {POST} select word, cast(sum(tf) as bigint) freq from post group by 1 having sum(tf)>=50"
    q["suggest_top5"] = (f"with {POST}, v as (select word, cast(sum(tf) as bigint) freq from post where starts_with(word,'{PREFIX}') group by 1 having sum(tf)>=50) "
                         "select row_number() over (order by freq desc, word) as rank, word, freq from v order by freq desc, word limit 5")
    q["suggest_prefix_table"] = (
        f"with {POST}, v as (select word, cast(sum(tf) as bigint) freq from post group by 1 having sum(tf)>=50), "
        "x as (select substring(word,1,n) prefix, word, freq from v, range(1,(select max(length(word))+1 from v)) r(n) where n<=length(word)) "
        "select * from (select prefix, row_number() over (partition by prefix order by freq desc, word) as rank, word, freq from x) where rank<=5")
    q["assoc_tokens"] = f"with {CORPUS}, x as (select doc_id, unnest({TW.replace('(t,', '(text,')}) word from corpus) select doc_id, word, count(*) tf from x group by 1,2"
    q["assoc_vocab"] = f"with {TROWS} select word, freq from voc"
    q["assoc_cooccurrence"] = f"with {COOC} select * from pairs"
    q["assoc_top20"] = f"with {COOC} select target, context, cnt, rank from top20"
    q["assoc_export"] = (
        f"with {COOC} select '{{\"'||word||'\":['||coalesce(string_agg('\"'||context||'\"', ',' order by rank),'')||']}}' as value "
        "from voc left join top20 on target=word group by word")
    q["query_synonyms"] = f"with {SYN} select * from syns"
    q["expanded_search"] = _expanded(_search(EXPANDED), "0")
    bonus = "50*coalesce((select max(score) from pr10 where pr10.id={}.doc_id),0)"
    q["expanded_hybrid_search"] = _expanded(_search(EXPANDED, extra=_pagerank(10) + ",", bonus=bonus.format("sc")), bonus.format("p"))
    up = "replace(replace({},chr(10),' '),'|','-')"
    q["ingest_parse"] = (
        f"select line_no, coalesce({up.format('title')},'Uploaded Document') title, coalesce({up.format('coalesce(authors,submitter)')},'System Updater') authors, "
        "coalesce(update_date, versions[1].created,'2025-01-01') date, coalesce(replace(replace(id,chr(10),''),'|','-'),'upload/new') original_id from raw_papers")
    q["ingest_title_fallback"] = (
        "with t as (select doc_id, substring(trim(split_part(coalesce(text,''),chr(10),1)),1,60) l, coalesce(json_valid(text),false) j from documents) "
        "select doc_id, case when l='' or j then 'Uploaded Document' else l end title, 'System Updater' authors, '2025-01-01' date, 'upload/new' original_id from t")
    raw = ("json_merge_patch('{}', to_json(struct_pack(id:=id,title:=title,abstract:=abstract,authors:=authors,categories:=categories,"
           "update_date:=update_date,submitter:=submitter,versions:=versions)))")
    ups = (f"with {CORPUS}, up as (select row_number() over (order by line_no)-1+(select max(doc_id)+1 from corpus) doc_id, *, {raw} j from raw_papers), "
           f"utok as (select doc_id, lower(unnest(regexp_extract_all(cast(j as varchar),'[A-Za-z0-9]+'))) w, generate_subscripts(regexp_extract_all(cast(j as varchar),'[A-Za-z0-9]+'),1) p from up), "
           f"ukeep as (select * from utok where w not in {STOP})")
    q["ingest_append"] = (
        f"{ups}, ulen as (select doc_id, count(*) dl from ukeep group by 1) select doc_id, coalesce(replace(replace(id,chr(10),''),'|','-'),'upload/new') original_id, "
        f"coalesce({up.format('title')},'Uploaded Document') title, coalesce({up.format('coalesce(authors,submitter)')},'System Updater') authors, "
        "'New' as category, coalesce(update_date, versions[1].created,'2025-01-01') date, coalesce(dl,0) dl from up left join ulen using(doc_id)")
    q["stream_ingest"] = q["ingest_append"].replace("order by line_no)-1+(select max(doc_id)+1 from corpus)", f"order by cast({raw} as varchar))-1")
    q["ingest_forward"] = (
        f"{ups}, {KEEP.replace(CORPUS + ', ', '', 1)}, {lex}, fresh as (select row_number() over (order by f)-1+(select max(word_id)+1 from lx) word_id, w word from "
        "(select w, min((doc_id,p)) f from ukeep where w not in (select word from lx) group by 1)), al as (select * from lx union all select * from fresh), "
        "fp as (select doc_id, w word, count(*) freq from ukeep group by 1,2) "
        "select doc_id, word_id, freq, cast(sum(freq) over (partition by doc_id) as bigint) total, count(*) over (partition by doc_id) uniq from fp join al using(word)")
    newtok = (f"nt as (select line_no, lower(unnest(regexp_extract_all(coalesce(abstract,''),'[A-Za-z0-9]+'))) w, "
              "generate_subscripts(regexp_extract_all(coalesce(abstract,''),'[A-Za-z0-9]+'),1) p from raw_papers)")
    q["ingest_lexicon_delta"] = (
        f"with {newtok}, f as (select w, min((line_no,p)) f from nt where w not in {STOP} and w not in (select lower(trim(word)) from lexicon where word is not null) group by 1) "
        "select row_number() over (order by f) - 1 + (select max(word_id)+1 from lexicon) word_id, w word from f")
    q["p3_codes"] = (
        r"""with x as (select line_no, list_filter(list_transform(regexp_extract_all(coalesce(categories,''), '"[^"]*"|''[^'']*''|[^\s,;|\[\]{}()"'']+'), """
        r"""lambda v: trim(v, ' "''')), lambda v: v not in ('','/','&','+','and','·')) v from raw_papers) """
        "select line_no, generate_subscripts(v,1) pos, unnest(v) as value from x")
    q["p2_found"] = f"with {_ORPH} select tab, field, row_id, kind, period from orph"
    q["p2_report"] = f"with {_ORPH} select tab, field, kind, period, count(*) n from orph group by 1,2,3,4"
    return q
