"""The work-registry tables as views over the driver's tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {
    "v_items": """select concat('o',o_orderkey) id,
 case when o_orderkey%7=0 then 'object' else 'function' end kind,
 case when o_orderkey%11=0 then null else concat('u',o_custkey%97) end unit_id,
 case when o_orderstatus='F' then 'accepted' when o_orderkey%13=0 then 'blocked' else 'pending' end lifecycle,
 case when o_orderstatus='F' then 'FULL_MATCH' when o_orderstatus='P' then 'NOT_STARTED'
      when o_orderkey%5=0 then 'NOT_BUILDABLE' else 'CODE_MATCH' end status,
 r_name region, concat('sym_',o_orderkey%5000) symbol,
 case when o_orderkey%19=0 then null else cast(floor(o_totalprice) as bigint) end size,
 o_orderkey%5 attempts, o_orderkey%17=0 exhausted, o_orderkey%3=0 ready,
 case when o_orderkey%23=0 then '{bad' else concat('{"prio":"',o_orderpriority,'","n":',o_orderkey%9,',"tags":["',o_orderstatus,'"],"d":{"k":',o_orderkey%4,'}}') end meta,
 o_orderdate updated_at
 from orders join customer on c_custkey=o_custkey join nation on n_nationkey=c_nationkey join region on r_regionkey=n_regionkey""",
    "v_deps": """select distinct concat('o',l_orderkey) from_id, concat('o',case when l_partkey%50=0 then l_partkey+90000000 else l_partkey end) to_id,
 case l_returnflag when 'A' then 'calls' when 'N' then 'depends_on' else 'unresolved_calls' end kind from lineitem""",
    "v_status": """select 'wf' workflow_id, unit_id, '' target_id, 'LINTED' status from (select distinct unit_id from v_items where unit_id is not null) u where try_cast(substring(unit_id,2) as int)%4=0
 union all select 'wf','',id,'TEXT_MATCH' from v_items where cast(substring(id,2) as bigint)%23=0
 union all select 'wf',unit_id,id,'EXACT_MATCH' from v_items where unit_id is not null and cast(substring(id,2) as bigint)%29=0""",
    "v_events": """select event_id+1 seq, ts, concat('run',user_id%20) run_id, concat('o',user_id) work_item_id, event_type as type,
 case when event_type='error' then 'error' else 'info' end level, props data from events""",
    "v_usage": """select event_id id, ts, concat('run',user_id%20) run_id, concat('m',user_id%5) model,
 cast(floor(value*1000) as bigint) input_tok, cast(floor(value*100) as bigint) output_tok, event_id%500 cache_read, event_id%50 cache_write
 from events where event_type in ('purchase','view')""",
    "v_models": "select concat('m',r_regionkey) name, 20*r_regionkey rpm, cast(r_regionkey as double)*0.5 p_in, 1.5 p_out, 0.25 p_cr, 1.0 p_cw from region where r_regionkey<4",
    "v_audit": """select event_id id, ts, concat('tok',user_id%10) actor, case when event_id%2=0 then 'run-complete' else 'run-failed' end action,
 concat('run',user_id%20) run_id, case when event_id%9=0 then null else cast(floor(value*100) as bigint) end cost_micro_usd from events where event_type in ('purchase','signup')""",
    "v_sources": "select concat('src/',source,'/',doc_id,case when doc_id%5=0 then '.h' when doc_id%3=0 then '.c' else '.cpp' end) path, source unit, doc_id, text from documents",
    "v_sources_old": "select path, unit, doc_id, case when doc_id%3=0 then replace(text,' the ',' teh ') else text end text from v_sources where doc_id%10<>9",
    # C-like files, one a document, of twenty lines each; what stands on a line follows from the id alone
    "v_code": """select concat('src/u',doc_id%97,'/',doc_id,case when doc_id%10=7 then '.h' when doc_id%10=3 then '.c' else '.cpp' end) path, concat('u',doc_id%97) unit, doc_id, concat_ws(chr(10),
 case when doc_id%3=0 then '#include <vector>' else concat('#include "u',doc_id%7,'.h"') end,
 concat('extern "C" void func_80',lpad(cast(doc_id as varchar(20)),6,'0'),'(CGame* self, int b);'),
 case when doc_id%4=0 then concat('extern "C" int lbl_80',lpad(cast(doc_id as varchar(20)),6,'0'),';') else concat('int g',doc_id,';') end,
 concat('struct S',doc_id,' { int a; int b; };'),
 concat('int CGame::run',doc_id%50,'(void* p, int x) {'),
 concat('  u8* q = (u8*)p + 0x',doc_id%9+1,';'),
 case when doc_id%2=0 then concat('  *(int*)((u8*)p + ',doc_id%6,') = 1;') else '  if (x) { goto out; }' end,
 concat('  x = reinterpret_cast<int>(y = ',doc_id%5,') + 1; z = static_cast<int>(w = 2);'),
 concat('  sym_',doc_id%5000,'(x); // call'),
 concat('  x = reinterpret_cast<int>(y = ',doc_id%5+5,') + 1;'),
 'out:',
 concat('  return self_',doc_id%20,'(x);'),
 '}',
 concat('#define func_8000',lpad(cast(doc_id%10000 as varchar(20)),4,'0'),' realName',doc_id%3),
 concat('void self_',doc_id%20,'(CGame* self) {'),
 '  ((CGame*)self)->x = names[3];',
 '}',
 case when doc_id%5=0 then concat('asm void raw',doc_id,'(int r3) {') else concat('int tail',doc_id,';') end,
 case when doc_id%5=0 then '  li r3, 7' else ' ' end,
 case when doc_id%5=0 then '}' else ' ' end) text from documents""",
    # C++ files of declarations and definitions of C linkage, with comments across lines, joined lines and a linkage block
    "v_headers": """select concat('src/h',doc_id%97,'/',doc_id,'.cpp') path, doc_id, concat_ws(chr(10),
 concat('extern "C" __declspec(section ".init") void f1_',doc_id,'(int a);'),
 concat('extern "C" void f2_',doc_id,'(int a,'),
 'int b); /* tail',
 'extern "C" int hidden; */ int open;',
 'extern "C" struct T { int x; };',
 concat('extern "C" int f3_',doc_id,'(CGame* _this) { // }'),
 '  return ((CGame*)_this)->x; /* } */',
 '}',
 'extern "C" {',
 concat('  int lbl_80',lpad(cast(doc_id as varchar(20)),6,'0'),';'),
 concat('  void f4_',doc_id,'(int a,'),
 '    int b);',
 '  int f5(void) { return 1; }',
 '  typedef int U;',
 '  int e = 3;',
 '}',
 concat('extern "C" void (*cb_',doc_id,')(int);'),
 concat('extern "C" void* __ct__',doc_id,'(CGame* self) { ((CGame*)self)->x = 1; }'),
 concat('int use',doc_id,' = f3_',doc_id,'(0);')) text from documents""",
    # symbols of two classes, some with names that no compiler would give
    "v_members": """select p_partkey ordinal, case p_partkey%12 when 0 then concat('m',p_partkey%300,'__5CGameFv') when 1 then concat('m',p_partkey%300,'__11CGameFv') when 2 then '__ct__5CGameFv' when 3 then concat('__ct__11CGameFP',p_partkey%9,'A')
 when 4 then '__dt__Q24game5CGameFv' when 5 then concat('m',p_partkey%300,'__Q24game9CGameFv') when 6 then concat('m',p_partkey%300,'__11CGameFi') when 7 then concat('m',p_partkey%300,'__11CGameFv@',p_partkey) when 8 then concat('__800B',lpad(cast(p_partkey%10000 as varchar(20)),4,'0'))
 when 9 then concat('func_80',lpad(cast(p_partkey as varchar(20)),6,'0')) when 10 then concat('m',p_partkey%300,'__7CPlayerFv') else concat('a__1b',p_partkey%300,'__44CPlayerFv') end name, p_partkey address_key from part""",
    # a status log of three scopes: a unit's target, a target of any unit, a unit
    "v_log": """select 'wf' workflow_id, case when event_id%5=0 then '' else concat('u',user_id%40) end unit_id, case when event_id%7=0 and event_id%5<>0 then '' else concat('o',user_id) end target_id,
 event_id+1 seq, event_type as status, concat('a',event_id%3) actor from events where event_id%5=0 or event_id%7=0 or event_id%3=0""",
    "v_code_old": """select path, unit, doc_id, case when doc_id%3=0 then replace(text,'  return self_','  return other_') when doc_id%3=1 then replace(text,' q = (u8*)',' r = (u8*)') else text end text from v_code where doc_id%10<>9""",
    "v_symbols": """select p_partkey ordinal, case when p_partkey%4=0 then concat('func_80',lpad(cast(p_partkey as varchar(20)),6,'0')) when p_partkey%4=1 then concat('lbl_80',lpad(cast(p_partkey-1 as varchar(20)),6,'0'))
 when p_partkey%4=2 then concat('m',p_partkey%300,'__5CGameFv') else replace(p_name,' ','_') end name,
 case when p_partkey%4=1 then p_partkey-1 else p_partkey end address_key from part""",
    "v_decls": """select s_suppkey ord, case s_suppkey%6 when 0 then concat('func_80',lpad(cast(s_suppkey as varchar(20)),6,'0')) when 1 then concat('lbl_80',lpad(cast(s_suppkey as varchar(20)),6,'0'),'_x')
 when 2 then concat('q',s_suppkey,'__5CGameFv') when 3 then 'red' when 4 then 'red_widget_jp' else concat('zz',s_suppkey) end name from supplier""",
    "v_insns": """select concat('file',l_orderkey%50) file, concat('f',l_orderkey%500) fn,
 row_number() over (partition by l_orderkey%50 order by l_orderkey%500,l_orderkey,l_linenumber,l_partkey,l_suppkey,l_extendedprice,l_quantity) idx,
 case l_linenumber when 1 then 'bl' when 2 then 'li' when 3 then 'lwz' when 4 then 'addi' when 5 then 'mr' when 6 then 'stw' else 'add' end mnemonic,
 case l_linenumber when 1 then concat('f',l_partkey%500) when 2 then concat('r3, 0x',l_partkey%8) when 3 then concat('r4, 0x',l_suppkey%64,'(r3)')
 when 4 then 'r3, r1, 0x8' when 5 then 'r3, r31' when 6 then concat('r5, 0x',l_partkey%64,'(r3)') else 'r3, r3, r4' end operands from lineitem""",
    "v_leases": """select event_id op_seq, ts, concat('o',user_id) work_item_id, concat('run',event_id%3,':',event_id%2) owner, concat('e',event_id%2) epoch,
 case event_type when 'signup' then 'claim' when 'view' then 'claim' when 'click' then 'heartbeat' when 'purchase' then 'release' else 'sweep' end op,
 3600000*(1+event_id%6) ttl_ms from events""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, or a view over tables, of a data folder."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for needed in sorted({t for t in (*TABLES, *VIEWS) if t != name and _names(VIEWS[name], t)}):
        view(spark, sf_dir, needed).createOrReplaceTempView(needed)
    return spark.sql(VIEWS[name])


def _names(sql: str, table: str) -> bool:
    words = sql.replace("(", " ").replace(")", " ").replace(",", " ").split()
    return any(a in ("from", "join") and b == table for a, b in zip(words, words[1:], strict=False))


def with_views(sql: str, *names: str) -> str:
    """sql with the views it needs as common tables, in order."""
    out: list[str] = []
    for n in names:
        for v in [*[v for v in VIEWS if v != n and _names(VIEWS[n], v)], n]:
            if v not in out:
                out.append(v)
    parts = [f"{v} as ({VIEWS[v]})" for v in VIEWS if v in out]
    sql = sql.strip()
    return "with " + ",\n".join(parts) + (",\n" + sql[5:] if sql.lower().startswith("with ") else "\n" + sql)
