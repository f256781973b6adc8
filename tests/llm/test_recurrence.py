"""Lines that recur in a site count over all of its pages, whatever the labeller's sample holds."""


def test_recurring_lines_are_frame_with_a_small_sample(spark):
    from textloom.llm.boilerplate import label_pages

    said = "This house keeps many old maps and letters for its guests."
    body = lambda k: f"The service number {k} reads the list of files before it writes the table. Another sentence about topic {chr(97 + k % 26)} follows here.\n\nOne more paragraph of the article explains the {'very ' * k}long option in detail."
    rows = [(k, f"https://s{k % 3}.x/{k}", f"# Title {k}\n\nSource: https://s{k % 3}.x/{k}\n\nHome | Blog | About us\n\n{body(k)}\n\n{said}") for k in range(60)]
    rows += [(100, None, rows[0][2]), (101, "https://s0.x/n", None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, content string")
    got = {r.page_id: r.frame for r in label_pages(df, max_pages=6).collect()}
    assert set(got) == set(range(60)) | {100}
    last = {k: c.split("\n").index(said) for k, _, c in rows[:60]}
    assert sum(last[k] in got[k] for k in range(60)) >= 57
    assert all(8 not in got[k] for k in range(60))
