"""Labelled text blocks: words and link density of the block before, the block itself and the
block after; 1 for content. Blocks of sixteen pages, looked through by hand, and of common layouts,
pages without navigation or footer among them."""

# fmt: off
LABELLED = [
    (0, 0, 1, 1, 1, 1, 0), (1, 1, 1, 1, 1, 1, 0), (1, 1, 1, 1, 8, 0, 0), (1, 1, 8, 0, 10, 0, 0), (8, 0, 10, 0, 51, 0, 1), (10, 0, 51, 0, 8, 0, 1),
    (51, 0, 8, 0, 11, 0, 1), (8, 0, 11, 0, 36, 0, 1), (11, 0, 36, 0, 32, 0, 1), (36, 0, 32, 0, 52, 0, 1), (32, 0, 52, 0, 25, 0, 1), (52, 0, 25, 0, 11, 0, 1),
    (25, 0, 11, 0, 0, 0, 0), (1, 1, 8, 0, 9, 0, 0), (8, 0, 9, 0, 12, 0, 1), (9, 0, 12, 0, 9, 0, 1), (12, 0, 9, 0, 39, 0, 1), (9, 0, 39, 0, 8, 0, 1),
    (39, 0, 8, 0, 20, 0, 1), (8, 0, 20, 0, 8, 0, 1), (20, 0, 8, 0, 8, 0, 1), (8, 0, 8, 0, 0, 0, 0), (1, 1, 1, 1, 5, 0, 0), (1, 1, 5, 0, 2, 0, 0),
    (5, 0, 2, 0, 2, 0, 1), (2, 0, 2, 0, 11, 0, 1), (2, 0, 11, 0, 0, 0, 0), (1, 1, 8, 0, 11, 0, 0), (8, 0, 11, 0, 17, 0, 1), (11, 0, 17, 0, 143, 0, 1),
    (17, 0, 143, 0, 31, 0, 1), (143, 0, 31, 0, 189, 0, 1), (31, 0, 189, 0, 43, 0, 1), (189, 0, 43, 0, 51, 0, 1), (43, 0, 51, 0, 22, 0, 1), (51, 0, 22, 0, 11, 0, 1),
    (22, 0, 11, 0, 0, 0, 0), (1, 1, 8, 0, 8, 0, 0), (8, 0, 8, 0, 8, 0, 1), (8, 0, 8, 0, 45, 0, 1), (8, 0, 45, 0, 1, 0, 1), (45, 0, 1, 0, 30, 0, 1),
    (1, 0, 30, 0, 37, 0, 1), (30, 0, 37, 0, 47, 0, 1), (37, 0, 47, 0, 2, 0, 1), (47, 0, 2, 0, 1, 0, 1), (2, 0, 1, 0, 15, 0, 1), (1, 0, 15, 0, 3, 0, 1),
    (15, 0, 3, 0, 8, 0, 1), (3, 0, 8, 0, 14, 0, 1), (8, 0, 14, 0, 0, 0, 0), (1, 1, 1, 1, 11, 0, 0), (1, 1, 11, 0, 11, 0, 0), (11, 0, 11, 0, 65, 0, 1),
    (11, 0, 65, 0, 57, 0, 1), (65, 0, 57, 0, 5, 0, 1), (57, 0, 5, 0, 131, 0, 1), (5, 0, 131, 0, 21, 0, 1), (131, 0, 21, 0, 3, 0, 1), (21, 0, 3, 0, 82, 0, 1),
    (3, 0, 82, 0, 108, 0, 1), (82, 0, 108, 0, 29, 0, 1), (108, 0, 29, 0, 138, 0, 1), (29, 0, 138, 0, 31, 0, 1), (138, 0, 31, 0, 61, 0, 1), (31, 0, 61, 0, 38, 0, 1),
    (61, 0, 38, 0, 16, 0, 1), (38, 0, 16, 0, 55, 0, 1), (16, 0, 55, 0, 11, 0, 1), (55, 0, 11, 0, 28, 0, 1), (11, 0, 28, 0, 41, 0, 1), (28, 0, 41, 0, 1, 0, 1),
    (41, 0, 1, 0, 91, 0, 1), (1, 0, 91, 0, 39, 0, 1), (91, 0, 39, 0, 102, 0, 1), (39, 0, 102, 0, 64, 0, 1), (102, 0, 64, 0, 12, 0, 1), (64, 0, 12, 0, 0, 0, 0),
    (1, 1, 1, 1, 9, 0, 0), (1, 1, 9, 0, 7, 0, 0), (9, 0, 7, 0, 968, 0, 1), (7, 0, 968, 0, 9, 0, 1), (968, 0, 9, 0, 7, 0, 1), (9, 0, 7, 0, 0, 0, 0),
    (1, 1, 1, 1, 4, 0, 0), (1, 1, 4, 0, 6, 0, 0), (4, 0, 6, 0, 6, 0, 1), (6, 0, 6, 0, 10, 0, 1), (6, 0, 10, 0, 15, 0, 1), (10, 0, 15, 0, 0, 0, 0),
    (1, 1, 1, 1, 12, 0, 0), (1, 1, 12, 0, 11, 0, 0), (12, 0, 11, 0, 149, 0, 1), (11, 0, 149, 0, 46, 0, 1), (149, 0, 46, 0, 1, 0, 1), (46, 0, 1, 0, 76, 0, 1),
    (1, 0, 76, 0, 9, 0, 1), (76, 0, 9, 0, 0, 0, 0), (1, 1, 1, 1, 6, 0, 0), (1, 1, 6, 0, 8, 0, 0), (6, 0, 8, 0, 12, 0, 1), (8, 0, 12, 0, 8, 0, 1),
    (12, 0, 8, 0, 3, 0, 1), (8, 0, 3, 0, 38, 0, 1), (3, 0, 38, 0, 36, 0, 1), (38, 0, 36, 0, 28, 0, 1), (36, 0, 28, 0, 6, 0, 1), (28, 0, 6, 0, 25, 0, 1),
    (6, 0, 25, 0, 32, 0, 1), (25, 0, 32, 0, 13, 0, 1), (32, 0, 13, 0, 0, 0, 0), (1, 1, 1, 1, 10, 0, 0), (1, 1, 10, 0, 4, 0, 0), (10, 0, 4, 0, 4, 0, 1),
    (4, 0, 4, 0, 47, 0, 1), (4, 0, 47, 0, 75, 0, 1), (47, 0, 75, 0, 43, 0, 1), (75, 0, 43, 0, 95, 0, 1), (43, 0, 95, 0, 11, 0, 1), (95, 0, 11, 0, 49, 0, 1),
    (11, 0, 49, 0, 178, 0, 1), (49, 0, 178, 0, 10, 0, 1), (178, 0, 10, 0, 0, 0, 0), (1, 1, 1, 1, 7, 0, 0), (1, 1, 7, 0, 5, 0, 0), (7, 0, 5, 0, 5, 0, 1),
    (5, 0, 5, 0, 15, 0, 1), (5, 0, 15, 0, 0, 0, 0), (1, 1, 12, 0, 12, 0, 0), (12, 0, 12, 0, 184, 0, 1), (12, 0, 184, 0, 9, 0, 1), (184, 0, 9, 0, 10, 0, 1),
    (9, 0, 10, 0, 0, 0, 0), (1, 1, 7, 0, 11, 0, 0), (7, 0, 11, 0, 37, 0, 1), (11, 0, 37, 0, 17, 0, 1), (37, 0, 17, 0, 13, 0, 1), (17, 0, 13, 0, 24, 0, 1),
    (13, 0, 24, 0, 61, 0, 1), (24, 0, 61, 0, 22, 0, 1), (61, 0, 22, 0, 74, 0, 1), (22, 0, 74, 0, 61, 0, 1), (74, 0, 61, 0, 72, 0, 1), (61, 0, 72, 0, 120, 0, 1),
    (72, 0, 120, 0, 88, 0, 1), (120, 0, 88, 0, 19, 0, 1), (88, 0, 19, 0, 9, 0, 1), (19, 0, 9, 0, 20, 0, 1), (9, 0, 20, 0, 13, 0, 1), (20, 0, 13, 0, 0, 0, 0),
    (1, 1, 10, 0, 9, 0, 0), (10, 0, 9, 0, 9, 0, 1), (9, 0, 9, 0, 133, 0, 1), (9, 0, 133, 0, 4, 0, 1), (133, 0, 4, 0, 11, 0, 1), (4, 0, 11, 0, 29, 0, 1),
    (11, 0, 29, 0, 10, 0, 1), (29, 0, 10, 0, 14, 0, 1), (10, 0, 14, 0, 0, 0, 0), (1, 1, 11, 0, 5, 0, 0), (11, 0, 5, 0, 5, 0, 1), (5, 0, 5, 0, 30, 0, 1),
    (5, 0, 30, 0, 31, 0, 1), (30, 0, 31, 0, 31, 0, 1), (31, 0, 31, 0, 31, 0, 1), (31, 0, 31, 0, 1, 0, 1), (31, 0, 1, 0, 9, 0, 1), (1, 0, 9, 0, 12, 0, 1),
    (9, 0, 12, 0, 0, 0, 0), (0, 0, 1, 1, 1, 1, 0), (3, 1, 2, 1, 2, 1, 0), (2, 1, 3, 1, 1, 1, 0), (1, 1, 12, 0.92, 4, 1, 0), (4, 1, 9, 1, 25, 0.04, 0),
    (30, 0.9, 22, 0.95, 3, 1, 0), (80, 0.02, 6, 1, 7, 1, 0), (5, 1, 6, 1, 5, 1, 0), (14, 0.8, 10, 0.7, 8, 1, 0), (40, 0.03, 18, 0.9, 0, 0, 0), (60, 0.02, 75, 0.05, 90, 0, 1),
    (12, 0, 48, 0.04, 66, 0.02, 1), (45, 0, 33, 0.12, 28, 0.1, 1), (7, 1, 52, 0.02, 61, 0.03, 1), (90, 0, 40, 0.05, 6, 1, 1), (3, 1, 34, 0.06, 41, 0, 1), (25, 0, 110, 0.1, 4, 1, 1),
    (55, 0.05, 21, 0.1, 70, 0, 1), (120, 0.01, 15, 0, 95, 0.02, 1), (18, 0, 27, 0, 44, 0, 1),
    (1, 1, 36, 0, 24, 0, 1), (2, 1, 30, 0, 2, 1, 1), (1, 1, 45, 0, 60, 0, 1), (4, 1, 28, 0, 35, 0, 1), (2, 1, 70, 0, 12, 0, 1), (5, 1, 40, 0, 0, 0, 1), (1, 1, 25, 0, 40, 0, 1), (3, 1, 55, 0, 20, 0, 1),
    # long last blocks, pages of one block, pages without navigation or footer
    (60, 0, 45, 0, 0, 0, 1), (90, 0, 200, 0, 0, 0, 1), (40, 0, 30, 0, 0, 0, 1), (120, 0.02, 80, 0.03, 0, 0, 1), (25, 0, 150, 0, 0, 0, 1), (12, 0, 65, 0, 0, 0, 1),
    (8, 0, 35, 0, 0, 0, 1), (50, 0.05, 100, 0.05, 0, 0, 1), (60, 0, 24, 0, 0, 0, 1), (35, 0.06, 22, 0, 0, 0, 1), (70, 0, 90, 0.08, 0, 0, 1), (30, 0.1, 40, 0, 0, 0, 1),
    (0, 0, 500, 0, 0, 0, 1), (0, 0, 60, 0, 0, 0, 1), (0, 0, 120, 0.02, 0, 0, 1), (0, 0, 35, 0, 0, 0, 1), (0, 0, 24, 0.04, 0, 0, 1), (0, 0, 2000, 0, 0, 0, 1),
    (0, 0, 40, 0, 60, 0, 1), (0, 0, 90, 0, 50, 0.02, 1), (0, 0, 30, 0.03, 45, 0, 1), (0, 0, 8, 0, 40, 0, 1), (0, 0, 6, 0, 90, 0, 1), (0, 0, 11, 0, 55, 0, 1),
    # short blocks and paragraphs with links after paragraphs with links; footers after such paragraphs
    (60, 0.03, 4, 0, 60, 0, 1), (40, 0.025, 12, 0, 80, 0, 1), (30, 0.07, 8, 0, 45, 0, 1), (20, 0.1, 9, 0, 80, 0, 1), (90, 0.02, 3, 0, 35, 0, 1), (75, 0.04, 10, 0, 50, 0.02, 1),
    (12, 0.17, 7, 0, 40, 0, 1), (45, 0.05, 6, 0, 9, 0, 1), (60, 0, 20, 0.1, 8, 0, 1), (60, 0, 24, 0.08, 40, 0, 1), (30, 0, 28, 0.1, 50, 0, 1), (60, 0, 12, 0.17, 30, 0, 1),
    (50, 0, 10, 0.1, 60, 0, 1), (60, 0.03, 9, 0, 0, 0, 0), (45, 0.05, 12, 0, 0, 0, 0), (80, 0.02, 11, 0, 0, 0, 0), (35, 0.06, 10, 0, 0, 0, 0), (20, 0.1, 14, 0, 0, 0, 0),
    # links that begin a page, follow paragraphs or come before the first paragraph
    (0, 0, 1, 1, 1, 1, 0), (0, 0, 3, 1, 60, 0, 0), (0, 0, 1, 1, 300, 0, 0), (0, 0, 5, 0.9, 8, 0, 0), (0, 0, 2, 1, 2, 1, 0), (0, 0, 8, 1, 40, 0, 0),
    (50, 0, 4, 1, 5, 1, 0), (60, 0, 6, 1, 9, 0, 0), (70, 0.02, 5, 0.9, 11, 0, 0), (90, 0, 12, 1, 8, 1, 0), (40, 0, 3, 1, 10, 0, 0), (30, 0.05, 25, 0.9, 12, 0, 0),
    (1, 1, 1, 1, 70, 0, 0), (2, 1, 2, 1, 120, 0, 0), (1, 1, 3, 1, 30, 0.05, 0), (4, 1, 2, 1, 45, 0, 0), (60, 0.1, 2, 1, 0, 0, 0), (80, 0, 1, 1, 0, 0, 0),
    # short blocks before blocks of a word or two
    (100, 0, 8, 0, 1, 0, 1), (50, 0, 8, 0, 1, 0, 1), (8, 0, 8, 0, 1, 0, 1), (2, 0, 2, 0, 1, 0, 1), (10, 0, 11, 0, 2, 0, 1), (15, 0, 10, 0, 1, 0, 1),
    # longer notices between links and the article, longer footers
    (1, 1, 13, 0, 9, 0, 0), (1, 1, 13, 0, 5, 0, 0), (1, 1, 13, 0, 11, 0, 0), (1, 1, 15, 0, 8, 0, 0), (2, 1, 16, 0, 7, 0, 0), (1, 1, 17, 0, 10, 0, 0),
    (24, 0, 16, 0, 0, 0, 0), (9, 0, 16, 0, 0, 0, 0), (58, 0, 16, 0, 0, 0, 0), (60, 0, 16, 0, 0, 0, 0), (5, 0, 17, 0, 0, 0, 0), (40, 0, 18, 0, 0, 0, 0),
    (1, 1, 9, 0, 40, 0, 0), (1, 1, 12, 0, 25, 0, 0), (2, 1, 14, 0, 60, 0, 0), (1, 1, 8, 0, 14, 0, 0), (3, 1, 10, 0, 35, 0, 0), (1, 1, 16, 0, 12, 0, 0),
    # short paragraphs and headings one after the other
    (9, 0, 8, 0, 6, 0, 1), (8, 0, 12, 0, 9, 0, 1), (30, 0, 7, 0, 5, 0, 1), (12, 0, 15, 0, 8, 0, 1), (6, 0, 10, 0, 11, 0, 1), (45, 0, 17, 0, 10, 0, 1),
]
