"""sightline.streaming"""
