"""boutline.operators"""
