"""Small COCO-shaped test documents written by the tests themselves."""

import json
import os

CATS = [{"id": 1, "name": "bolt", "supercategory": "part"}, {"id": 2, "name": "nut", "supercategory": "part"},
        {"id": 3, "name": "gauge", "supercategory": "tool"}]


def small_doc():
    images = [{"id": i, "file_name": f"img_{i:03d}.jpg", "width": 640, "height": 480} for i in range(1, 11)]
    anns = []
    aid = 1
    # image 1 gets two boxes (and image 3); nut (2) appears on images 2, 5, 7, 10; 17 boxes in total
    plan = {1: [1, 3], 2: [2], 3: [1, 3], 4: [3], 5: [2, 1], 6: [3, 3], 7: [2], 8: [1, 1], 9: [3, 1], 10: [2, 3]}
    for img, cats in plan.items():
        for c in cats:
            anns.append({"id": aid, "image_id": img, "category_id": c, "bbox": [10.0 * aid, 20.0, 30.0, 40.0],
                         "area": 1200.0, "iscrowd": 1 if aid == 10 else 0})
            aid += 1
    return {"info": {}, "licenses": [], "categories": CATS, "images": images, "annotations": anns}


def malformed_doc():
    return {"images": [{"id": 40, "file_name": "north.png", "width": 32, "height": 24},
                       {"id": 41, "file_name": "south.png", "height": 24}],
            "annotations": [{"id": 70, "image_id": 40, "category_id": 12, "bbox": [5, 6, 7, 8]},
                            {"id": 71, "image_id": 41, "category_id": 1, "bbox": [5]},
                            {"id": 72, "image_id": 41, "category_id": 1, "bbox": []},
                            {"id": 73, "image_id": 41, "bbox": None}]}


def predictions():
    items = [{"image_id": i, "category_id": 1 + i % 3, "bbox": [10.0, 20.0, 30.0, 40.0], "score": 0.1 * i}
             for i in range(1, 9)]
    items.append({"image_id": 3, "category_id": 999, "bbox": [1, 1, 1, 1], "score": 0.5})
    return items


def write(path, obj):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        json.dump(obj, f)
    return path
