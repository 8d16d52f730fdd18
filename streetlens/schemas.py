"""Schemas of the tables that stages exchange."""

from __future__ import annotations

CAMERA = (
    "pano string, src_image string, src_hw array<int>, out_hw array<int>, hfov_deg double, direction string, yaw_deg double, "
    "split array<int>, K array<array<double>>, fx double, fy double, cx double, cy double"
)
SEG_META = (
    "image string, img_hw array<int>, detections array<struct<class_id:int,class_name:string,area_px:bigint>>, "
    "ground_px bigint, vehicle_px bigint, road_px bigint, sidewalk_px bigint"
)
DEPTH_META = "image string, img_hw array<int>, depth_scale double, convention string"
DSI = (
    "pano string, dirs_present array<string>, occ_source map<string,string>, l_vis_m double, d_stopping_m double, a_shadow_m2 double, "
    "a_total_m2 double, v_heavy double, dsi_refined double, grade string, include_vehicles boolean, l_vis_veh_m double, "
    "a_shadow_veh_m2 double, dsi_veh double, grade_veh string, h_leak double, hazard_edges bigint, haz_r double"
)
LABEL_PX = "pano string, dir string, u int, v int, class_id int"
DEPTH_PX = "pano string, dir string, u int, v int, depth_norm float"
CELL = "pano string, layer string, col int, row int"
