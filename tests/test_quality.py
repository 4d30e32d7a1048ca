"""Validators: each rule broken once, plus one row breaking two."""

from frames import D, comment, post, tables, user

from contentlens.operators import quality as qa


def reasons(df, key="id"):
    return {r[key]: sorted(r["reasons"]) for r in df.collect()}


def test_v1_users(spark):
    existing = tables(spark, users=[user(1)]).users
    batch = spark.createDataFrame(
        [(1, "ok@x.org", "fine", None), (2, "bad-email", "alsofine", None), (3, "b@x.org", "ab", None),
         (4, "u1@x.org", "user1", None), (5, "c@x.org", "dupname", None), (6, "d@x.org", "dupname", "x" * 101),
         (7, "nope", "no", None)],
        "seq long, email string, username string, full_name string",
    )
    got = reasons(qa.validate_users(batch, existing), "seq")
    assert got == {
        1: [], 2: ["email_invalid"], 3: ["username_length"], 4: ["email_taken", "username_taken"],
        5: [], 6: ["full_name_length", "username_taken"], 7: ["email_invalid", "username_length"],
    }
    valid, rejects = qa.split(qa.validate_users(batch, existing))
    assert valid.count() == 2 and rejects.count() == 5


def test_v2_categories(spark):
    cats = spark.createDataFrame([(1, "a", "root", None, 0), (2, "b", "child", 1, 0)], "id int, name string, slug string, parent_id int, `order` int")
    batch = spark.createDataFrame(
        [(10, "ok", "new-one", 1, 1), (11, "", "x", None, 2), (12, "bad", "Bad_Slug", None, 3), (13, "t", "root", None, 4),
         (14, "p", "orphan", 99, 5), (1, "a", "root", 2, 6), (15, "y" * 101, "-x", None, 7)],
        "id int, name string, slug string, parent_id int, seq long",
    )
    got = reasons(qa.validate_categories(batch, cats))
    assert got == {
        10: [], 11: ["name_length"], 12: ["slug_invalid"], 13: ["slug_taken"], 14: ["parent_not_found"],
        1: ["parent_cycle"], 15: ["name_length", "slug_invalid"],
    }


def test_v3_posts(spark):
    t = tables(spark, users=[user(1)], cats=[(5, "c", "c", None, 0)])
    batch = spark.createDataFrame(
        [(1, "t", "c", 1, "draft", None), (2, "", "c", 1, "draft", None), (3, "t", "", 1, "draft", None),
         (4, "t", "c", 1, "secret", None), (5, "t", "c", 9, "draft", None), (6, "t", "c", 1, "draft", 7),
         (7, "x" * 256, "c", 9, "draft", 5)],
        "id long, title string, content string, author_id long, status string, category_id int",
    )
    got = reasons(qa.validate_posts(batch, t.users, t.categories))
    assert got == {1: [], 2: ["title_length"], 3: ["content_empty"], 4: ["status_invalid"], 5: ["author_not_found"],
                   6: ["category_not_found"], 7: ["author_not_found", "title_length"]}


def test_v4_comments(spark):
    t = tables(spark, users=[user(1)], posts=[post(1, 1), post(2, 1, allow=False), post(3, 1)],
               comments=[comment(50, 1, 1), comment(51, 1, 3)])
    batch = spark.createDataFrame(
        [(1, "fine", 1, None), (2, "", 1, None), (3, "x", 9, None), (4, "x", 2, None), (5, "x", 1, 77), (6, "x", 1, 51),
         (7, "y" * 1001, 2, None)],
        "id long, content string, post_id long, parent_id long",
    )
    got = reasons(qa.validate_comments(batch, t.posts, t.comments))
    assert got == {1: [], 2: ["content_length"], 3: ["post_not_found"], 4: ["comments_not_allowed"],
                   5: ["parent_not_found"], 6: ["parent_other_post"], 7: ["comments_not_allowed", "content_length"]}


def test_v5_like_requests(spark):
    t = tables(spark, users=[user(1), user(2)], posts=[post(1, 1)], comments=[comment(10, 1, 1), comment(11, 1, 1)],
               likes=[(2, 11, D(2024, 1, 1))])
    req = spark.createDataFrame(
        [(1, 10, D(2024, 1, 2)), (1, 10, D(2024, 1, 2)), (1, 10, D(2024, 1, 3)), (9, 10, D(2024, 1, 2)),
         (1, 99, D(2024, 1, 2)), (2, 11, D(2024, 1, 4)), (9, 99, D(2024, 1, 5))],
        "user_id long, comment_id long, created_at timestamp_ntz",
    )
    out = sorted((r["user_id"], r["comment_id"], r["created_at"].day, ",".join(r["reasons"]), r["requests"])
                 for r in qa.validate_like_requests(req, t.users, t.comments, t.comment_likes).collect())
    assert out == [
        (1, 10, 2, "", 1), (1, 10, 2, "already_liked", 1), (1, 10, 3, "already_liked", 1),
        (1, 99, 2, "comment_not_found", 1), (2, 11, 4, "already_liked", 1),
        (9, 10, 2, "user_not_found", 1), (9, 99, 5, "comment_not_found,user_not_found", 1),
    ]
